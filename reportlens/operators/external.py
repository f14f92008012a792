"""The two pluggable model calls: report text to document, text to vector.

The caller passes a plain function for a list of texts. Batches, retries, guards, validation and status
columns are handled here; a small thread pool in each task covers slow services.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions import vectors as V
from ..sources.tables import text_key
from . import answers, tables
from .answers import with_retry


def extract(reports: DataFrame, id_col: str, text_col: str, extractor: Callable[[str], str], role: str = "",
            template: Mapping = fixed.TEMPLATE, rules: Sequence[Mapping] = (), done: DataFrame | None = None,
            required: Sequence[str] = tuple(fixed.REQUIRED_SECTIONS), attempts: int = 3, wait: float = 4,
            threads: int = 8, overwrite: bool = False, kept: str | None = None, model: str = "",
            slice_rows: int = answers.SLICE_ROWS) -> DataFrame:
    """(id, doc, status, attempts, error): documents a model reads out of reports.

    status is ok, skipped (too short), failed (no answer), invalid (no JSON or missing sections). With kept, the folder
    of an answer log, the calls are made at once, in slices, each prompt once per model; later runs take what is there.
    """
    todo = reports if done is None else tables.not_done(reports, done, [id_col], overwrite)
    usable, rejected = tables.split_usable(todo, text_col)
    asked = usable.select(id_col, text.prompt(F.col(text_col), role, template, rules).alias("prompt"))
    run = with_retry(extractor, attempts, wait)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(run, pdf["prompt"]))
                yield pd.DataFrame({id_col: pdf[id_col], "answer": [g[0] for g in got],
                                    "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    id_type = reports.schema[id_col].dataType.simpleString()
    if kept is None:
        got = asked.mapInPandas(call, f"{id_col} {id_type}, answer string, attempts int, error string")
    else:
        questions = asked.select(F.struct(id_col).alias("row"), text_key(model, "prompt", F.col("prompt")).alias("key"),
                                 F.col("prompt").alias("body"))
        got = answers.answered(questions, kept, lambda texts: [extractor(t) for t in texts], attempts=attempts, wait=wait,
                               threads=threads, slice_rows=slice_rows).select("row.*", "answer", "attempts", "error")
    read = got.withColumn("doc", text.recover_json(F.col("answer")))
    lacking = F.size(text.missing_keys(F.col("doc"), required)) > 0
    status = F.when(F.col("answer").isNull(), "failed").when(F.col("doc").isNull() | lacking, "invalid").otherwise("ok")
    ok = read.select(id_col, "doc", status.alias("status"), "attempts", "error")
    short = rejected.select(id_col, F.lit(None).cast("string").alias("doc"), F.lit("skipped").alias("status"),
                            F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(short)


def pattern_extractor(patterns: Mapping[str, str]) -> Callable[[str], str]:
    """A deterministic extractor for tests: 'section.key' -> regular expression with one group."""
    import json
    compiled = {p: re.compile(r) for p, r in patterns.items()}

    def run(body: str) -> str:
        doc: dict = {}
        for path, rx in compiled.items():
            node, *rest = path.split(".")
            found = rx.search(body)
            value = found.group(1) if found else ""
            if rest:
                doc.setdefault(node, {})[rest[0]] = value
            else:
                doc[node] = value
        return "Result: " + json.dumps(doc)

    return run


def embed_texts(df: DataFrame, text_col: str, embedder: Callable[[list[str]], Sequence[Sequence[float]]], dim: int,
                out: str = "embedding", attempts: int = 3, wait: float = 4, batch: int = 64, kept: str | None = None,
                model: str = "", threads: int = 8, slice_rows: int = answers.SLICE_ROWS) -> DataFrame:
    """Add a vector per text; each distinct text is sent once, empty and failed ones get the zero vector.

    Empty texts, the likely hot key, never enter the join. With kept, the folder of an answer log, vectors come from the
    log and a column <out>_status tells ok, failed or empty.
    """
    if kept is not None:
        rows = df.select(F.struct(*df.columns).alias("row"), F.nullif(F.col(text_col), F.lit("")).alias("body"))
        asks = rows.where("body is not null").withColumn("key", text_key(model, "text", F.col("body")))
        floats = lambda texts: [np.asarray(v, dtype=np.float32) for v in embedder(texts)]
        got = answers.answered(asks, kept, floats, "array<float>", attempts=attempts, wait=wait, threads=threads,
                               batch=batch, slice_rows=slice_rows)
        full = got.select("row.*", V.fit_dim(F.col("answer"), dim).alias(out), F.col("status").alias(f"{out}_status"))
        return full.unionByName(rows.where("body is null").select(
            "row.*", V.zeros(dim).alias(out), F.lit("empty").alias(f"{out}_status")))

    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.withColumn("_key", F.when(F.coalesce(F.col(text_col), F.lit("")) != "", key))
    distinct = rows.where("_key is not null").groupBy("_key").agg(F.min(text_col).alias("t"))
    run = with_retry(embedder, attempts, wait)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                vecs, _, error = run(part["t"].tolist())
                if error is not None:           # one bad text must not cost the others their vectors
                    each = [run([t]) for t in part["t"]]
                    vecs = [None if e is not None else v[0] for v, _, e in each]
                yield pd.DataFrame({"_key": part["_key"], "_vec": [
                    None if v is None else np.asarray(v, dtype=np.float32) for v in vecs]})

    vecs = distinct.mapInPandas(call, "_key string, _vec array<float>")
    full, empty = rows.where("_key is not null"), rows.where("_key is null")
    joined = full.join(vecs, "_key", "left").withColumn(out, V.fit_dim(F.col("_vec"), dim)).drop("_key", "_vec")
    return joined.unionByName(empty.withColumn(out, V.zeros(dim)).drop("_key"))


def hashing_embedder(dim: int) -> Callable[[list[str]], list[np.ndarray]]:
    """The hashing vector as a plain function, for tests of the model call."""
    import hashlib

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for body in texts:
            vec = np.zeros(dim, dtype=np.float32)
            for word in body.lower().split():
                digest = hashlib.md5(word.encode()).hexdigest()
                vec[int(digest[:8], 16) % dim] += 1 if digest[8] < "8" else -1
            out.append(vec)
        return out

    return run
