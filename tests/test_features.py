import copy
import json

import pytest
from pyspark.sql import functions as F

from rotativa.operators import features as f
from rotativa.plans.driver_tables import ANSWER
from rotativa.plans.extraction import checked_features, extract_features
from rotativa.schemas import FEATURES

ARTICLE = "diario string, fecha string, seccion string, titulo string, contenido string, url string"


def valid():
    record = json.loads(
        json.dumps(ANSWER)
        .replace("@actor@", "bcra").replace("@tipo@", "fiscal").replace('"@dias@"', "7").replace('"@dir@"', "-0.5")
        .replace('"@tema@"', "true").replace('"@puntaje@"', "0.95").replace("@notas@", "n")
    )
    return record


def changed(**paths):
    record = copy.deepcopy(valid())
    for path, value in paths.items():
        *parents, leaf = path.split("__")
        node = record
        for p in parents:
            node = node[p]
        if value is KeyError:
            del node[leaf]
        else:
            node[leaf] = value
    return json.dumps(record)


@pytest.fixture
def check(spark):
    def run(response):
        df = spark.createDataFrame([("D", "2025-01-01", "S", "u", response)], "diario string, fecha string, seccion string, url string, response string")
        return checked_features(df).first()

    return run


def test_prompt(spark):
    df = spark.createDataFrame([("D", None, "S", None, "ñ" * 9000, "u"), ("D", "f", "S", "t", None, None)], ARTICLE)
    long, empty = (r["user_prompt"] for r in f.with_prompt(df).collect())
    assert long.count("ñ") == 8000
    assert long.startswith("Diario: D\nFecha: unknown\nSeccion: S\nTitulo: unknown\nContenido: ñ")
    assert "Contenido: \nURL: unknown\n" in empty
    custom = f.with_prompt(df, template="{titulo}|{url}", system="sys").collect()[0]
    assert (custom["system_prompt"], custom["user_prompt"]) == ("sys", "unknown|u")


def test_valid_answer(check):
    row = check(changed())
    assert row["violations"] == [] and not row["corrupt"]
    features = row["features"]
    assert features["confianza"] == 0.25 and features["evento"]["horizonte_dias"] == 7
    assert features["entidades"]["tickers_mencionados"] == []
    assert (features["diario"], features["fecha"], features["seccion"], features["url"]) == ("D", "2025-01-01", "otra", "u")


@pytest.mark.parametrize(
    "change,violation",
    [
        ({"evento__tipo_evento": "raro"}, "enum:evento.tipo_evento"),
        ({"entidades__tipo_actor_principal": "unknown"}, "enum:entidades.tipo_actor_principal"),
        ({"mercado__merval__direccion": -1.5}, "range:mercado.merval.direccion"),
        ({"mercado__merval__magnitud": -0.5}, "range:mercado.merval.magnitud"),
        ({"confianza": 1.01}, "range:confianza"),
        ({"confianza": "alta"}, "type:confianza"),
        ({"confianza": KeyError}, "missing:confianza"),
        ({"tematicas__menciona_fmi": "quizas"}, "type:tematicas.menciona_fmi"),
        ({"evento__horizonte_dias": "pronto"}, "type:evento.horizonte_dias"),
        ({"evidencia__citas_evidencia": ["a", "b", "c", "d"]}, "quotes"),
        ({"calidad_fuente__calidad_fuente_score": 0.5}, "quality_band"),
    ],
)
def test_violations(check, change, violation):
    assert check(changed(**change))["violations"] == [violation]


def test_repairs(check):
    row = check(changed(evento__tipo_evento="raro", evento__horizonte_dias="unknown", entidades__nombre_actor_principal="Banco", mercado__merval__direccion="0.5", tematicas__menciona_fmi="false"))
    features = row["features"]
    assert features["evento"]["tipo_evento"] == "desconocido"
    assert features["evento"]["horizonte_dias"] is None
    assert features["entidades"]["nombre_actor_principal"] == "Banco"
    assert features["mercado"]["merval"]["direccion"] == 0.5
    assert features["tematicas"]["menciona_fmi"] is False
    assert row["violations"] == ["enum:evento.tipo_evento"]


def test_cut_off_answer_keeps_its_row(check):
    row = check(changed()[:-20])
    assert row["corrupt"]
    assert row["features"]["diario"] == "D"
    assert "missing:confianza" in row["violations"]


def test_flatten(spark):
    df = spark.createDataFrame([(changed(),)], "response string")
    flat = f.flatten(f.parse_features(df))
    assert len(flat.columns) == 39
    assert flat.first()["mercado__merval__direccion"] == -0.5
    assert {"diario", "evento__horizonte_dias", "tematicas__menciona_salarios_paritarias", "evidencia__citas_evidencia"} <= set(flat.columns)
    assert dict(flat.dtypes)["evento__horizonte_dias"] == "int"
    assert len(list(f._leaves(FEATURES))) == 39


@pytest.mark.parametrize(
    "text,expected",
    [
        ("['a', \"b's\"]", ["a", "b's"]),
        ("[]", []),
        ('["x"]', ["x"]),
        (r"['a\xa0b', 'it\'s']", ["a b", "it's"]),
        ("nada", None),
    ],
)
def test_list_text(one, text, expected):
    assert one(f.read_list_text("s"), s=text) == expected


def failing_loader():
    answer = changed()

    def load():
        def score(prompts):
            if "malo" in prompts[0]:
                raise RuntimeError("no")
            return [answer]

        return score

    return load


def test_a_failed_call_marks_its_row(spark):
    df = spark.createDataFrame([("D", "f", "S", "t", "bueno", "u1"), ("D", "f", "S", "t", "malo", "u2")], ARTICLE)
    found = {r["url"]: r for r in f.score(f.with_prompt(df), failing_loader(), tasks=2).collect()}
    assert found["u1"]["error"] is None and found["u1"]["response"]
    assert found["u2"]["response"] is None and "RuntimeError" in found["u2"]["error"]


def test_the_model_is_asked_once_per_row(spark):
    df = spark.createDataFrame([("D", "f", "S", "t", "x", "u1")], ARTICLE)
    asked = f.score(f.with_prompt(df), failing_loader()).filter("error is null")
    assert asked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("rounds", [1, 3])
def test_stored_answers_are_not_asked_again(spark, tmp_path, rounds):
    log = tmp_path / "calls"
    log.mkdir()
    folder, answer = str(log), changed()

    def load():
        import uuid

        def score(prompts):
            if any("malo" in p for p in prompts):
                raise RuntimeError("no")
            for _ in prompts:
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return [answer] * len(prompts)

        return score

    data = [("D", "f", "S", "t", f"texto {i % 5}", f"u{i % 5}") for i in range(20)] + [("D", "f", "S", "t", "malo", "u9")]
    prompts = f.with_prompt(spark.createDataFrame(data, ARTICLE))
    path = f"{tmp_path}/answers"
    first = f.score_missing(prompts, load, path, rounds=rounds)
    assert first.count() == 21 and first.filter("response is null").count() == 1
    assert len(list(log.iterdir())) == 5
    again = f.score_missing(prompts, load, path, rounds=rounds)
    assert again.count() == 21 and len(list(log.iterdir())) == 5


def test_whole_flow(spark, tmp_path):
    df = spark.createDataFrame([("D", "2025-01-01", "S", "t", "bueno", "u1"), ("D", "2025-01-01", "S", "t", "malo", "u2")], ARTICLE)
    found = {r["url"]: r for r in extract_features(df, failing_loader()).collect()}
    assert found["u1"]["features"]["diario"] == "D" and found["u1"]["violations"] == []
    assert found["u2"]["features"]["url"] == "u2"
    stored = extract_features(df, failing_loader(), f"{tmp_path}/answers")
    assert stored.filter(F.size("violations") == 0).count() == 1


def test_outline_lists_what_is_checked(spark):
    lines = f.record_outline().split("\n")
    assert "mercado.merval.direccion: double [-1, 1]" in lines
    assert "confianza: double [0, 1]" in lines
    assert any(x.startswith("evento.shock: string {positivo, ") for x in lines)
    assert "evidencia.citas_evidencia: array<string> size <= 3" in lines
    df = spark.createDataFrame([("d", "2025-01-01", "s", "t", "c", "u")], "diario string, fecha string, seccion string, titulo string, contenido string, url string")
    assert f.with_prompt(df).first()["system_prompt"] == f.record_outline()


def test_a_scorer_gets_few_prompts_at_once(spark):
    df = spark.range(1000).coalesce(1).selectExpr("cast(id AS string) AS user_prompt")
    rows = f.score(df, lambda: lambda prompts: [f"{len(prompts)} {p}" for p in prompts]).collect()
    assert max(int(r["response"].split()[0]) for r in rows) <= 256
    assert all(r["response"].split()[1] == r["user_prompt"] and r["error"] is None for r in rows) and len(rows) == 1000
