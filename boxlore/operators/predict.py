"""Running a user's model over rows. Models stay user code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _attempt(fn: Callable, part: pd.DataFrame, names: list[str]) -> list[pd.Series] | Exception:
    try:
        out = fn(part)
        columns = [out[name] for name in names]
        return columns if len(out) == len(part) else ValueError("model returned another number of rows")
    except Exception as e:  # the model is foreign code
        return e


def _answers(fn: Callable, part: pd.DataFrame, names: list[str], default: Mapping[str, object]) -> pd.DataFrame:
    """Outputs of one batch with ``error``; a batch that fails is tried row by row.

    The answers of single rows are gathered in lists: frames per row, and putting these together,
    cost more than the model's calls do.
    """
    out = _attempt(fn, part, names)
    if not isinstance(out, Exception):
        return pd.DataFrame({name: column.reset_index(drop=True) for name, column in zip(names, out, strict=True)}).assign(error=None)
    rows, errors = [], []
    fallback = [default.get(name) for name in names]
    for i in range(len(part)):
        one = _attempt(fn, part.iloc[i : i + 1].reset_index(drop=True), names) if len(part) > 1 else out
        failed = isinstance(one, Exception)
        rows.append(fallback if failed else [column.array[0] for column in one])
        errors.append(str(one) if failed else None)
    columns = {name: pd.Series([row[k] for row in rows], dtype=object).infer_objects() for k, name in enumerate(names)}
    return pd.DataFrame({**columns, "error": pd.Series(errors, dtype=object)})


def batch_predict(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], id_col: str, outputs: T.StructType | str,
    default: Mapping[str, object], batch_size: int = 64,
) -> DataFrame:
    """Apply a scoring function in batches.

    ``factory`` runs once per task and returns a function from a frame of rows to a frame of
    outputs of equal length. A batch that fails is tried row by row; a row that fails gets
    ``default`` and its message in ``error``.
    """
    out = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    names = [f.name for f in out.fields]
    schema = T.StructType([df.schema[id_col], *out.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                yield pd.concat([part[[id_col]], _answers(fn, part, names, default)], axis=1)[[id_col, *names, "error"]]

    return df.mapInPandas(run, schema)


def multi_voter(df: DataFrame, voters: Mapping[int, Callable], id_col: str = "ann_id", batch_size: int = 64) -> DataFrame:
    """Several voters over the same rows, long format ``ann_id, voter, match, reason``.

    One pass: every batch is shown to all voters. A voter that fails on a row gives no vote and
    the reason why.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("voter", T.IntegerType()), T.StructField("match", T.BooleanType()), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {number: factory() for number, factory in voters.items()}
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                for number, fn in models.items():
                    votes = _answers(fn, part, ["match", "reason"], {})
                    pairs = zip(votes["reason"].tolist(), votes["error"].tolist(), strict=True)
                    reason = pd.Series([r if e is None else f"error: {e[:50]}" for r, e in pairs], dtype=object)
                    yield pd.DataFrame({id_col: part[id_col], "voter": number, "match": votes["match"].astype(object), "reason": reason})

    return df.mapInPandas(run, schema)


def ensemble_config(spark: SparkSession, config: Mapping) -> DataFrame:
    """Model table ``model_id, name, file, imgsz, tta_flip, weight`` from the list layout or the lettered one."""
    flip = config.get("tta_flip", False)
    at = lambda key, i, fallback: (config.get(key) or [])[i] if i < len(config.get(key) or []) else fallback
    rows = []
    models = config.get("models")
    for i, m in enumerate(models if isinstance(models, list) else []):
        if isinstance(m, Mapping) and m.get("file"):
            rows.append((m.get("name", chr(65 + i)), m["file"], int(m.get("imgsz", 1280)), bool(m.get("tta_flip", flip)), float(m.get("weight", 1.0))))
    if not rows:
        for i, letter in enumerate("abc"):
            if f"model_{letter}" in config:
                rows.append((letter.upper(), config[f"model_{letter}"], int(config.get(f"imgsz_{letter}", 1280)),
                             bool(at("tta_flip_models", i, flip)), float(at("weights", i, 1.0))))
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "model_id int, name string, file string, imgsz int, tta_flip boolean, weight double")
