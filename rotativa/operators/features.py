"""Features extracted from articles by an external model: prompt, score, parse, check, flatten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotativa.constants import ENUMS, MAX_QUOTES, PROMPT_CHARS, QUALITY_BANDS
from rotativa.functions.text import fill_template, or_default, truncate_chars
from rotativa.operators.joins import join_one
from rotativa.schemas import FEATURES
from rotativa.sources.readers import table_or_empty

METADATA = ["diario", "fecha", "seccion", "url"]

USER_PROMPT = (
    "Diario: {diario}\n"
    "Fecha: {fecha}\n"
    "Seccion: {seccion}\n"
    "Titulo: {titulo}\n"
    "Contenido: {contenido}\n"
    "URL: {url}\n"
)

Scorer = Callable[[list[str]], list[str | None]]
# Prompts that a scorer gets at once.
CALLS = 256


def with_prompt(
    df: DataFrame, template: str = USER_PROMPT, system: str | None = None, max_chars: int = PROMPT_CHARS
) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt``.

    Instructions are the caller's; without any, ``system`` lists the fields of the record and what
    ``validate_features`` allows in each. The article text is cut to ``max_chars``, the length the model is asked to read. Missing text
    is empty, other missing fields read "unknown".
    """
    fields = {c: or_default(F.col(c).cast("string"), "unknown") for c in ("diario", "fecha", "seccion", "titulo", "url")}
    fields["contenido"] = truncate_chars(or_default("contenido"), max_chars)
    return df.withColumns({"system_prompt": F.lit(record_outline() if system is None else system), "user_prompt": fill_template(template, fields)})


def score(df: DataFrame, load_scorer: Callable[[], Scorer], prompt: str = "user_prompt", tasks: int | None = None) -> DataFrame:
    """Add the model's answer as ``response`` and a failure as ``error``.

    The scorer gets up to ``CALLS`` prompts at once; where that fails, each prompt on its own, so a
    failing call marks its row only. ``tasks`` bounds how many calls run at once.
    """
    spread = df if tasks is None else df.repartition(tasks)

    @F.arrow_udf("struct<response:string,error:string>")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = load_scorer()
        for batch in batches:
            # Only a slice of a batch is held as Python texts, whatever the session's batch size.
            for at in range(0, len(batch), CALLS):
                prompts = batch.slice(at, CALLS).to_pylist()
                try:
                    answers = list(scorer(prompts))
                    errors = [None] * len(prompts)
                    if len(answers) != len(prompts):
                        raise ValueError("the scorer gave another number of answers")
                except Exception:
                    answers, errors = [], []
                    for text in prompts:
                        try:
                            answers.append(scorer([text])[0])
                            errors.append(None)
                        except Exception as error:
                            answers.append(None)
                            errors.append(f"{type(error).__name__}: {error}")
                yield pa.StructArray.from_arrays([pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["response", "error"])

    # Otherwise a filter on the answer is pushed below the projection and asks everything twice.
    ask = ask.asNondeterministic()
    return spread.withColumn("_answer", ask(prompt)).select(*df.columns, "_answer.response", "_answer.error")


ANSWERS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("prompt_sha", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def score_missing(
    df: DataFrame, load_scorer: Callable[[], Scorer], answers_path: str, tasks: int | None = None, rounds: int = 1
) -> DataFrame:
    """Score the prompts not answered yet, store the answers, and return all rows with theirs.

    Answers are keyed by the hash of the prompt, which holds the URL, so equal articles are asked
    about once, with or without a URL, and a second run asks nothing. With ``rounds`` > 1 the work is
    appended in that many parts, and a lost job repeats only its part. Failed calls are stored with
    their ``error``, come back with it, and are tried again next time.
    """
    spark = df.sparkSession
    keyed = df.withColumn("prompt_sha", F.sha2("user_prompt", 256))
    table_or_empty(spark, answers_path, ANSWERS)
    for part in range(rounds):
        done = table_or_empty(spark, answers_path, ANSWERS).filter("error IS NULL").select("prompt_sha").distinct()
        todo = (
            keyed.filter(F.pmod(F.xxhash64("prompt_sha"), F.lit(rounds)) == part)
            .groupBy("prompt_sha")
            .agg(F.min("url").alias("url"), F.min("user_prompt").alias("user_prompt"))
            .join(done, "prompt_sha", "left_anti")
        )
        score(todo, load_scorer, tasks=tasks).select(*ANSWERS.names).write.mode("append").parquet(answers_path)
    # One row per prompt: an answer if there is one, else what went wrong.
    worth = F.struct(F.col("error").isNull(), F.coalesce("response", "error"))
    answers = table_or_empty(spark, answers_path, ANSWERS).groupBy("prompt_sha").agg(
        F.max_by("response", worth).alias("response"), F.max_by("error", worth).alias("error")
    )
    return join_one(keyed, answers, ["prompt_sha"], "left")


# Parsing. Scalars are read as text first, because a quoted number or boolean would otherwise be
# lost, and cast afterwards.


def _as_text(schema: T.DataType) -> T.DataType:
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in schema.fields])
    return schema if isinstance(schema, T.ArrayType) else T.StringType()


def _struct(schema: T.StructType, leaf: Callable[[str, T.DataType], str], prefix: str = "") -> str:
    """SQL of a struct shaped like ``schema`` whose leaves come from ``leaf(path, type)``.

    Records this wide are built from SQL text: one expression to parse instead of hundreds of
    column objects.
    """
    parts = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        nested = isinstance(f.dataType, T.StructType)
        value = _struct(f.dataType, leaf, f"{path}.") if nested else leaf(path, f.dataType)
        parts.append(f"'{f.name}', {value}")
    return f"named_struct({', '.join(parts)})"


def _cast_leaf(path: str, kind: T.DataType) -> str:
    if isinstance(kind, (T.ArrayType, T.StringType)):
        return f"raw.{path}"
    if isinstance(kind, T.IntegerType):
        # A whole number may be written with a fraction, as in 21.0.
        number = f"try_cast(raw.{path} AS DOUBLE)"
        return f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS INT) END"
    return f"try_cast(raw.{path} AS {kind.simpleString()})"


def parse_features(df: DataFrame, response: str = "response", schema: T.StructType = FEATURES) -> DataFrame:
    """Add ``raw`` (all scalars as text), ``features`` (typed) and ``corrupt`` (unreadable answer)."""
    text_schema = _as_text(schema).add("_corrupt_record", T.StringType())
    parsed = df.withColumn(
        "raw", F.from_json(response, text_schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    return parsed.withColumns(
        {"features": F.expr(_struct(schema, _cast_leaf)), "corrupt": F.col("raw._corrupt_record").isNotNull()}
    )


def _leaves(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, f"{path}.")
        else:
            yield path, f.dataType


def _bounds(path: str, kind: T.DataType) -> tuple[float, float] | None:
    """Least and greatest value of a field with a range."""
    if isinstance(kind, T.DoubleType):
        return (-1.0 if path.endswith(".direccion") else 0.0), 1.0
    return None


def record_outline(schema: T.StructType = FEATURES) -> str:
    """One line per field of the record: path, type, and the values, range or number allowed."""
    lines = []
    for path, kind in _leaves(schema):
        line = f"{path}: {kind.simpleString()}"
        if path in ENUMS:
            line += f" {{{', '.join(ENUMS[path])}}}"
        elif bounds := _bounds(path, kind):
            line += f" [{bounds[0]:g}, {bounds[1]:g}]"
        elif path == "evidencia.citas_evidencia":
            line += f" size <= {MAX_QUOTES}"
        lines.append(line)
    lines += [f"calidad_fuente.categoria = {name}: [{low:g}, {high:g}]" for name, (low, high) in QUALITY_BANDS.items()]
    return "\n".join(lines)


_OPTIONAL = {*METADATA, "evento.horizonte_dias", "evidencia.notas", "entidades.nombre_actor_principal"}
_LISTS = {"entidades.empresas_mencionadas", "entidades.tickers_mencionados", "entidades.sectores_mencionados"}


def _in(path: str, allowed: list[str]) -> str:
    return f"features.{path} IN ({', '.join(repr(a) for a in allowed)})"


def _checks(schema: T.StructType) -> list[str]:
    """SQL of one violation text, or null, per rule."""
    rules = []
    for path, kind in _leaves(schema):
        if isinstance(kind, (T.DoubleType, T.BooleanType)):
            rules.append((f"raw.{path} IS NULL", f"missing:{path}"))
            rules.append((f"raw.{path} IS NOT NULL AND features.{path} IS NULL", f"type:{path}"))
        elif isinstance(kind, T.IntegerType):
            known = f"lower(raw.{path}) NOT IN ('unknown', 'desconocido')"
            rules.append((f"{known} AND features.{path} IS NULL", f"type:{path}"))
        elif isinstance(kind, T.StringType) and path not in _OPTIONAL:
            rules.append((f"raw.{path} IS NULL", f"missing:{path}"))
        if bounds := _bounds(path, kind):
            rules.append((f"features.{path} NOT BETWEEN {bounds[0]}D AND {bounds[1]}D", f"range:{path}"))
    rules += [(f"NOT {_in(path, allowed)}", f"enum:{path}") for path, allowed in ENUMS.items()]
    quotes = "features.evidencia.citas_evidencia"
    rules.append((f"{quotes} IS NULL", "missing:evidencia.citas_evidencia"))
    rules.append((f"size({quotes}) > {MAX_QUOTES}", "quotes"))
    source = "features.calidad_fuente"
    for name, (low, high) in QUALITY_BANDS.items():
        outside = f"{source}.calidad_fuente_score NOT BETWEEN {low}D AND {high}D"
        rules.append((f"{source}.categoria = '{name}' AND {outside}", "quality_band"))
    return [f"CASE WHEN {test} THEN '{text}' END" for test, text in rules]


def _repaired_leaf(path: str, kind: T.DataType) -> str:
    if path in ENUMS:
        return f"CASE WHEN {_in(path, ENUMS[path])} THEN features.{path} ELSE 'desconocido' END"
    if path == "entidades.nombre_actor_principal":
        return f"coalesce(features.{path}, 'unknown')"
    if path in _LISTS:
        return f"coalesce(features.{path}, CAST(array() AS ARRAY<STRING>))"
    return f"features.{path}"


def validate_features(df: DataFrame, schema: T.StructType = FEATURES) -> DataFrame:
    """Add ``violations`` and repair ``features``: unknown enum values become "desconocido",
    absent lists become empty, an absent actor name becomes "unknown".

    Violations are ``missing:``, ``type:``, ``enum:`` and ``range:`` with the field path, plus
    ``quotes`` (too many) and ``quality_band`` (score outside the band of its category). A row whose
    call failed has the one violation ``call``.
    """
    violations = F.expr(f"array_compact(array({', '.join(_checks(schema))}))")
    if "error" in df.columns:
        violations = F.when(F.col("error").isNotNull(), F.array(F.lit("call"))).otherwise(violations)
    return df.withColumns(
        {
            "violations": violations,
            "features": F.expr(_struct(schema, _repaired_leaf)),
        }
    )


def backfill_metadata(df: DataFrame, columns: list[str] = METADATA) -> DataFrame:
    """Take paper, date, section and URL from the article where the answer left them out."""

    def leaf(path: str, kind: T.DataType) -> str:
        if path not in columns:
            return f"features.{path}"
        return f"coalesce(nullif(features.{path}, ''), CAST({path} AS STRING))"

    return df.withColumn("features", F.expr(_struct(df.schema["features"].dataType, leaf)))


def flatten(df: DataFrame, col: str = "features", separator: str = "__") -> DataFrame:
    """One column per leaf of a nested record, named by its path."""
    schema = df.schema[col].dataType
    return df.selectExpr(*[f"{col}.{path} AS {path.replace('.', separator)}" for path, _ in _leaves(schema)])


def read_list_text(c: Column | str) -> Column:
    """Array from a list written as ``['a', "b"]`` or as JSON; null when unreadable."""
    text = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(text, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    return F.from_json(
        text,
        T.ArrayType(T.StringType()),
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
