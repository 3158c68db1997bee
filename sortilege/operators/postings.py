"""Search for a text within draws by lists of three signs.

Every three signs in a row of a draw's number, date and list of numbers point to the draw. Postings lie sorted by
these signs, so a search reads the parts of the files that hold its own ones, keeps the draws that have all of them,
and looks at their texts in the end, as signs may stand apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .serving import matching

KEYS = ["game", "draw_number", "source"]
#: Postings, and draws, of one task's sort or count.
TASK_ROWS = 1_000_000
FIELDS = ("draw_number", "draw_date", "numbers")


def grams(c: Column) -> Column:
    """All stretches of three signs, in small letters."""
    t = F.lower(c)
    starts = F.when(F.length(t) >= 3, F.sequence(F.lit(1), F.length(t) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(t, i, F.lit(3)))


def build(draws: DataFrame, path: str) -> None:
    """Writes the postings (gram, game, draw_number, source) of draws that have a number, sorted by gram."""
    texts = F.array(*[F.coalesce(grams(F.col(c).cast("string")), F.array().cast("array<string>")) for c in FIELDS])
    rows = draws.filter("draw_number IS NOT NULL").select(F.explode(F.array_distinct(F.flatten(texts))).alias("gram"), *KEYS)
    # A frequent gram has many postings: the draw's number deals them on.
    # As many ranges as the rows need, so that no task's sort grows with the table.
    rows.repartitionByRange(_tasks(rows), "gram", "draw_number").sortWithinPartitions("gram").write.mode("overwrite").option("parquet.block.size", 1_000_000).parquet(path)


def _tasks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def usable(text: str) -> bool:
    """Whether the postings can answer: three signs or more, and none that stands for others."""
    return len(text) >= 3 and not set("%_\\") & set(text)


def candidates(postings: DataFrame, text: str) -> DataFrame:
    """KEYS of the draws that hold all of the text's stretches of three signs."""
    own = sorted({text.lower()[i : i + 3] for i in range(len(text) - 2)})
    hit = postings.filter(F.col("gram").isin(own))
    # A text of common signs hits nearly all draws: the counts are dealt over as many tasks as there are rows for.
    found = hit.repartition(_tasks(hit), *KEYS).groupBy(*KEYS).agg(F.countDistinct("gram").alias("c"))
    return found.filter(F.col("c") == len(own)).select(*[F.col(k).alias(f"p_{k}") for k in KEYS])


def search(draws: DataFrame, postings: DataFrame, text: str | None) -> DataFrame:
    """The draws in whose number, date or list of numbers the text occurs, as a scan finds them; texts that postings cannot answer are scanned for."""
    has = draws.filter("draw_number IS NOT NULL")
    if text and usable(text):
        same = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in KEYS]
        has = has.join(candidates(postings, text), same[0] & same[1] & same[2], "left_semi")
    return has.filter(matching(text))
