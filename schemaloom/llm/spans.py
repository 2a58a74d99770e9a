"""Byte spans of texts: joined back to the documents and cut out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import packed, unpacked

ADDED = ("n_bytes", "n_covered", "n_removed", "n_spans", "kept_bytes")


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(_row, id, hash, text): rows of one id and one text share a key, and with it their answers."""
    return packed(docs, id=id_column, hash=F.xxhash64(F.col(f"`{text}`")), text=text)


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that touch or overlap."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    starts = np.concatenate([[True], begins[1:] > ends[:-1]])
    return begins[starts], ends[np.concatenate([starts[1:], [True]])]


def cut_out(docs: DataFrame, spans: DataFrame, *, shortest: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_covered, n_removed, n_spans, kept_bytes``.

    ``spans``: id, hash, begin, end, remove: places in the UTF-8 bytes of a text. Spans that touch or overlap
    form runs; runs below ``shortest`` bytes are left alone. ``n_covered`` counts the bytes of the others; those of
    spans with ``remove`` among them are cut out. Null and empty texts have no bytes. All spans of a text, which are
    fewer than its bytes, meet the text in one row.
    """
    lists = spans.groupBy(F.col("id").alias("_i"), F.col("hash").alias("_h")).agg(
        F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"), F.collect_list("remove").alias("removes")
    )
    rows = keyed(docs, id_column, text)
    joined = rows.join(lists, F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")), "left")

    def run(text: pd.Series, begins: pd.Series, ends: pd.Series, removes: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, e, r in zip(text, begins, ends, removes):
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if b is None or not len(b):
                out.append((len(raw), 0, 0, 0, raw))
                continue
            b, e, r = np.asarray(b, np.int64), np.asarray(e, np.int64), np.asarray(r, bool)
            begin, end = merged(b, e)
            long = end - begin >= shortest
            inside = long[np.searchsorted(begin, b, "right") - 1] & r
            first, last = merged(b[inside], e[inside])
            left = zip(np.concatenate([[0], last]).tolist(), np.concatenate([first, [len(raw)]]).tolist())
            out.append((len(raw), int((end - begin)[long].sum()), int((last - first).sum()), len(first), b"".join(raw[x:y] for x, y in left)))
        return pd.DataFrame(out, columns=list(ADDED))

    schema = "n_bytes bigint, n_covered bigint, n_removed bigint, n_spans bigint, kept_bytes binary"
    cut = F.pandas_udf(run, schema, F.PandasUDFType.SCALAR)
    done = joined.select("_row", cut("text", "begins", "ends", "removes").alias("c"))
    return unpacked(done.select("_row", "c.*"), *ADDED)
