"""Quality rules with host verdicts.

Each document is measured by itself (``base_features``). Then the failures of
its rules are counted by host, and each host's failure rate is shrunk towards
the corpus by a beta prior fitted to all hosts. A host whose shrunken rate is
too high is *rejected* with all its documents; one whose rate is above the
corpus's with a probability of 0.95 is *doubted*: of its documents those that
fail a soft rule go too, which a host without a record is forgiven. Hosts that
differ from the corpus no more than by chance, or of which little is known, are
accepted.

The host table is aggregated before it is shuffled (a host of any size comes
to one row a task) and joined back; Spark broadcasts it only if it measures
it as small, and splits a hot host's rows otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changewatch.llm.common import Table, beside, by_bytes

BATCH_BYTES = 2_000_000
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\t\n\x0b\x0c\r "
#: Standard deviations below a posterior's mean that leave 0.95 of it above.
SURE = 1.645
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at 9 to 13 and 32 alone
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
        v = len(known)
        if v < 1 << 20:
            code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # too many words for the product of three
            pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
            code = pair * v + ids[2:]
        order = np.argsort(code, kind="stable")
        same = np.diff(code[order]) == 0
        if same.any():
            again = np.zeros(len(code), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            covered = np.zeros(len(words), dtype=bool)
            for i in range(3):
                covered[i : len(code) + i] |= again
            repeated = int(covered.sum())
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated


def base_features(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` with the five features (long), a row for each row; a null text is empty: all 0."""
    rows = beside(docs, keep, text)
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField(n, T.LongType()) for n in FEATURES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, len(keep), BATCH_BYTES):
            made = list(zip(*map(measure, texts), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, pa.int64()) for x in made)], names=schema.names)

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """Symbols for more than a tenth of the characters, a fifth of the words in repeats, or a repeated line for every twenty words."""
    return (10 * F.col("n_symbols") > F.col("word_chars")) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")) | (20 * F.col("n_dup_lines") > F.col("n_words"))


def rule_failed() -> Column:
    """What counts against a host: a base failure or a soft one."""
    return base_failed() | soft_failed()


def host_rates(failures: DataFrame, *, host: str = "source") -> DataFrame:
    """(host, n, failed, rate, above): each host's failure rate under a beta prior fitted by moments to all hosts.

    ``failures`` has the host and a boolean ``failed``. With m the mean of the
    hosts' rates weighted by documents and s2 their weighted variance less
    what sampling alone gives, the prior has mean m and m * (1 - m) / s2 - 1
    pseudo-documents, held between 1 and 1000 (1000 where hosts differ no more
    than by chance). above: whether the lower bound of the host's posterior - its
    mean less ``SURE`` of its standard deviations - is above the prior's mean. A
    null host is a host; a null ``failed`` counts as false.
    """
    hosts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("failed"), F.lit(False)).cast("long")).alias("failed"))
    r = F.col("failed") / F.col("n")
    whole = hosts.agg(
        F.sum("n").alias("_n"), F.sum("failed").alias("_f"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("n") * r * r).alias("_sq"),
    )  # one row
    m = F.col("_f") / F.col("_n")
    spread = F.col("_sq") / F.col("_n") - m * m - m * (1 - m) * (F.col("_k") - 1) / F.col("_n")
    weight = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / spread - 1))).otherwise(F.lit(1000.0))
    t = hosts.crossJoin(F.broadcast(whole.select("_n", "_f", m.alias("_m"), weight.alias("_w")))).withColumn("rate", (F.col("failed") + F.col("_m") * F.col("_w")) / (F.col("n") + F.col("_w")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("_w") + 1))
    return t.select(host, "n", "failed", (F.col("rate") - SURE * deviation > F.col("_m")).alias("above"), "rate")


def judge(docs: DataFrame, *, text: str = "text", key: str = "doc_id", host: str = "source", reject_above: float = 0.6) -> DataFrame:
    """key, host, the features, base_failed, host_rate, host_verdict and kept, a row for each row of ``docs``.

    host_verdict is reject (its shrunken failure rate exceeds
    ``reject_above``), doubt (above the corpus's, surely) or accept. kept is false if
    the document fails a base rule, its host is rejected, or its host is
    doubted and it fails a soft rule. Null texts are empty and fail; rows of a
    null host are one host; repeated rows each count. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))
    # both the host counts and the result read the features: written once, they are narrow
    features = Table(base_features(rows), "features").df.withColumns({"base_failed": base_failed(), "failed": rule_failed()})
    rates = host_rates(features.select("source", "failed"))
    verdict = F.when(F.col("rate") > reject_above, "reject").when(F.col("above"), "doubt").otherwise("accept")
    rates = rates.select(F.coalesce("source", F.lit("")).alias("_host"), F.col("source").isNull().alias("_none"), F.col("rate").alias("host_rate"), verdict.alias("host_verdict"))
    joined = features.join(rates, (F.coalesce(features["source"], F.lit("")) == rates["_host"]) & (features["source"].isNull() == rates["_none"]), "left")
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & ~((F.col("host_verdict") == "doubt") & F.col("failed"))
    out = joined.withColumn("kept", kept).drop("_host", "_none", "failed")
    return out.withColumnsRenamed({"doc_id": key, "source": host})
