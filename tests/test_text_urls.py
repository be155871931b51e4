import pytest
from pyspark.sql import functions as F

from rotativa.functions import text as t
from rotativa.functions import urls as u


@pytest.mark.parametrize(
    "raw,clean,words,stripped",
    [
        ("  a b \n\t c ", "a b c", 3, "a b \n\t c"),
        ("", "", 0, ""),
        ("  \n", "", 0, ""),
        ("uno", "uno", 1, "uno"),
        ("a\x1cb", "a b", 2, "a\x1cb"),
    ],
)
def test_whitespace(one, raw, clean, words, stripped):
    assert one(t.clean_text("s"), s=raw) == clean == " ".join(raw.split())
    assert one(t.word_count("s"), s=raw) == words == len(raw.split())
    assert one(t.strip_space("s"), s=raw) == stripped == raw.strip()
    assert one(t.char_count("s"), s=raw) == len(raw)


def test_missing_text(one):
    assert one(t.word_count("s"), s=None) == 0
    assert one(t.char_count("s"), s=None) == 0
    assert one(t.or_default("s", "unknown"), s=None) == "unknown"
    assert one(t.null_if_sentinel("s"), s="Fecha no encontrada") is None
    assert one(t.null_if_sentinel("s"), s="x") == "x"


def test_prefix_suffix_truncation(one):
    assert one(t.strip_prefix("s", "Ir a la nota "), s="Ir a la nota Uno") == "Uno"
    assert one(t.strip_prefix("s", "Ir a la nota "), s="Uno") == "Uno"
    assert one(t.strip_site_suffix("s", "LA NACION"), s="Hola - La Nacion ") == "Hola"
    assert one(t.strip_site_suffix("s", "LA NACION"), s="LA NACION - Hola") == "LA NACION - Hola"
    assert one(t.truncate_chars("s", 8000), s="ñ" * 9000) == "ñ" * 8000


def test_template(one):
    made = t.fill_template("Diario: {a}\n{b}{{x}}", {"a": F.col("s"), "b": F.lit(3)})
    assert one(made, s="D") == "Diario: D\n3{x}"


def test_long_paragraphs(spark):
    df = spark.createDataFrame([(["x" * 40, "y" * 41],)], "p array<string>")
    assert df.select(t.long_paragraphs("p")).first()[0] == ["y" * 41]


@pytest.mark.parametrize(
    "url,path,first,nid,matches",
    [
        ("https://x.com/Politica/a-nid07092025/?q=1", "/Politica/a-nid07092025/", "Politica", "07092025", True),
        ("https://x.com", "", None, None, False),
        ("https://x.com/a|b/politica/c", "/a|b/politica/c", "a|b", None, True),
        ("https://x.com/politica", "/politica", "politica", None, False),
        ("https://x.com/a?x=/politica/", "/a", "a", None, False),
    ],
)
def test_url_parts(one, url, path, first, nid, matches):
    assert one(u.url_path("s"), s=url) == path
    assert one(u.first_segment("s"), s=url) == first
    assert one(u.nid("s"), s=url) == nid
    assert one(u.in_sections("s", ["POLITICA", "economia"]), s=url) is matches


def test_links(one):
    assert one(u.absolute_url("s", "https://h"), s="/n") == "https://h/n"
    assert one(u.absolute_url("s", "https://h"), s="http://o/n") == "http://o/n"
    assert one(u.site_root("s"), s="https://h.com/a/b?c") == "https://h.com"
