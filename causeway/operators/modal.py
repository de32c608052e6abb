"""Sessions and windows that hold several modalities, each a vector a session.

A panel has a row for each session of a series: idx (from 0, without gaps), session, what else is to go along, and for each
modality a vector of fixed width and whether it is known. Windows are put together in chunks of issues, so a session is copied
to the few chunks whose windows hold it and not to every window, and a long series is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Issues whose windows are put together at once.
CHUNK = 128


def assembled(calendar: DataFrame, parts: dict[str, tuple[DataFrame, int]], by: Sequence[str] = ()) -> DataFrame:
    """calendar (by, idx and more) with a column for each part, a vector of its width, and <part>_known. parts: rows of by, idx
    (once at most) and vector. Sessions without a row, or with a null vector, get zeros and are not known; null elements of a
    vector are zeros."""
    out = calendar
    for name, (rows, width) in parts.items():
        zero = F.array_repeat(F.lit(0.0), width)
        full = F.transform(F.col("vector").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
        out = out.join(rows.select(*by, "idx", full.alias(name)), [*by, "idx"], "left")
        out = out.withColumns({name: F.coalesce(name, zero), f"{name}_known": F.col(name).isNotNull()})
    return out


def held_by(window: int, last_issue: Column) -> Column:
    """How many of the windows of the issues up to last_issue hold a session."""
    return F.greatest(F.least(F.col("idx") + window - 1, last_issue) - F.greatest(F.col("idx"), F.lit(window - 1)) + 1, F.lit(0))


def moments(panel: DataFrame, modalities: Sequence[str], window: int, last_issue: Column, by: Sequence[str] = (), floor: float = 1e-4) -> DataFrame:
    """modality, k, mean and sd (population, floor at least) of each element over all rows of the windows of the issues up to
    last_issue (or the last of its series). No window is made: a session counts as often as windows hold it. Deviations are taken from the mean, in a
    second pass, so large values lose no digits. Without such windows there are no rows."""
    named = lambda m: F.transform(m, lambda x, k: F.struct(F.lit(m).alias("modality"), k.alias("k"), x.alias("x")))
    ends = panel.groupBy(*by).agg(F.max("idx").alias("end_"))
    ended = panel.join(ends, list(by)) if by else panel.crossJoin(F.broadcast(ends))
    long = ended.withColumn("w_", held_by(window, F.least(last_issue, "end_"))).where("w_ > 0").select(*by, "w_", F.explode(F.flatten(F.array(*map(named, modalities)))).alias("c")).select(*by, "w_", "c.*")
    keys = [*by, "modality", "k"]
    means = long.groupBy(*keys).agg((F.sum(F.col("w_") * F.col("x")) / F.sum("w_")).alias("mean"))
    far = F.pow(F.col("x") - F.col("mean"), 2)
    return long.join(means, keys).groupBy(*keys).agg(F.first("mean").alias("mean"), F.greatest(F.sqrt(F.sum(F.col("w_") * far) / F.sum("w_")), F.lit(floor)).alias("sd"))


def standardized(panel: DataFrame, found: DataFrame, modalities: Sequence[str], by: Sequence[str] = (), most: float = 8.0) -> DataFrame:
    """panel with the modalities in standard scores by moments(), between -most and most; the others stay as they are. Scores are
    those of a session, whatever the window, so they are taken before windows are made. A series without moments goes."""
    cells = lambda m: F.array_sort(F.collect_list(F.when(F.col("modality") == m, F.struct("k", "mean", "sd")))).alias(f"{m}_moments_")
    wide = found.groupBy(*by).agg(*map(cells, modalities), F.count("*").alias("found_")).where("found_ > 0")
    both = panel.join(wide, list(by)) if by else panel.crossJoin(F.broadcast(wide))  # without series, one row
    at = lambda m, k, f: F.get(F.col(f"{m}_moments_"), k)[f]
    score = lambda m: F.transform(m, lambda x, k: F.greatest(F.lit(-most), F.least(F.lit(most), (x - at(m, k, "mean")) / at(m, k, "sd"))))
    return both.withColumns({m: score(m) for m in modalities}).select(*panel.columns)


def windows(panel: DataFrame, modalities: Sequence[str], window: int, *, by: Sequence[str] = (), carry: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """A row for each issue with a whole window: by, issue, session, the columns of carry as they are at the issue, and for each
    modality its vectors from the oldest session to the issue's, and <modality>_known, for each of them.

    window is 2 to 512 sessions, else ValueError. Series shorter than a window have no rows."""
    if not 2 <= window <= 512:
        raise ValueError("a window has 2 to 512 sessions")
    cells = [c for m in modalities for c in (m, f"{m}_known")]
    of = lambda i: F.floor(i / chunk)
    dealt = panel.select(*by, F.struct("idx", "session", *carry, *cells).alias("row"), F.explode(F.sequence(of(F.col("idx")), of(F.col("idx") + window - 1))).alias("chunk"))
    held = dealt.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") >= window)

    def ending(end: Column) -> Column:
        """The window whose last row has this place, from 1."""
        last, rows = F.get("rows", end - 1), F.slice("rows", end - window + 1, window)
        columns = [rows[c].alias(c) for c in cells]
        return F.struct(last["idx"].alias("issue"), last["session"].alias("session"), *(last[c].alias(c) for c in carry), *columns)

    # A chunk's rows before its first issue only fill windows; so do the first rows of a series.
    ends = F.filter(F.sequence(F.lit(window), F.size("rows")), lambda e: F.get("rows", e - 1)["idx"] >= F.col("chunk") * chunk)
    return held.select(*by, F.inline(F.transform(ends, ending)))
