"""Cutting oversized line regions at natural boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.languages import language_of

#: Penalty units of a cut: at the bound of a region with a symbol, of another one, before or after a blank line, elsewhere; each
#: level of indentation adds.
NAMED, BOUND, BLANK, INSIDE, LEVEL, MOST_LEVELS = 0, 1, 2, 12, 2, 20
#: Weight of uneven pieces against penalties, and the cost of one more piece.
UNEVEN, PIECE = 24.0, 30.0


def cut_profile(text: str) -> bytes:
    """For each line a byte that says where a cut after it lies: twice the level of indentation, and 1 more if no blank line is
    beside it. Lines end at ``\\n``; a final one starts no further line."""
    if not text:
        return b""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    out = bytearray(len(lines))
    indent, blank_below = 0, False
    for i in range(len(lines) - 1, -1, -1):
        line = lines[i]
        bare = line.lstrip()
        # The cut after line i lies above what was seen last: its indentation is that of the next line that is not blank.
        here_blank = not bare
        out[i] = 2 * min(indent, MOST_LEVELS) + (not blank_below and not here_blank)
        if not here_blank:
            lead = line[: len(line) - len(bare)]
            indent = lead.count("\t") + lead.count(" ") // 4 + (lead.count(" ") % 4 > 0)
        blank_below = here_blank
    if out:
        out[-1] = 0
    return bytes(out)


def cut_prices(profile: bytes, bounds: list[int], named: list[int]) -> np.ndarray:
    """The penalty of a cut after each line, given the lines (from 0) after which regions begin or end, and those with a symbol."""
    code = np.frombuffer(profile, np.uint8)
    price = np.where(code & 1, INSIDE, BLANK)
    for lines, most in ((bounds, BOUND), (named, NAMED)):
        at = np.array(lines, np.int64)
        at = at[(at >= 0) & (at < len(price))]
        price[at] = np.minimum(price[at], most)
    return (price + LEVEL * (code >> 1)).astype(np.uint8)


def split_lines(start: int, end: int, limit: int, overlap: int, penalties: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest pieces of lines start..end: each at most ``limit`` lines, each next one repeating ``overlap`` lines.

    ``penalties[i]`` is the price of a cut after line start + i. Dynamic programming over the last line of a piece
    minimises penalties, unevenness and the number of pieces. An overlap of the limit or more is cut to limit - 1; a
    limit below 1 counts as 1. A region within the limit stays whole.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    n = end - start + 1
    if n <= limit:
        return [(start, end)]
    step = limit - overlap
    wanted = (n - overlap) / -(-(n - overlap) // step)  # new lines of a piece if all are alike
    cost = np.full(n + 1, np.inf)  # cost[b]: lines 1..b are covered, the last piece ends at b
    back = np.zeros(n + 1, dtype=np.int64)
    cost[overlap] = 0.0  # the first piece repeats nothing: it starts at line 1, as if cut at ``overlap``
    for b in range(overlap + 1, n + 1):
        low = max(overlap, b - step)
        fresh = b - np.arange(low, b)
        options = cost[low:b] + UNEVEN * ((fresh - wanted) / wanted) ** 2
        best = int(np.argmin(options))
        cost[b] = options[best] + PIECE + (penalties[b - 1] if b < n else 0.0)
        back[b] = low + best
    ends = [n]
    while (at := int(back[ends[-1]])) > overlap:
        ends.append(at)
    ends.reverse()
    return [(start + (0 if i == 0 else ends[i - 1] - overlap), start + e - 1) for i, e in enumerate(ends)]


def split_regions(regions: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every region that has more lines than its limit: region_id, piece_no, start_line, end_line, n_pieces.

    The limit is that of the region's repository and language, else that of its language; the language is the given one
    or, if null or unknown, what the file's suffix means. Regions with a null bound, start below 1, end below start,
    without limit, without file or with a file without text give nothing; a bound past the last line becomes the last
    line. Cuts prefer bounds of regions with a symbol, then of other regions of the file, then
    blank lines, then little indentation. Repeated rows
    count once. Only penalties, one byte a line, travel: texts are read where they lie. Regions of one hot file are spread
    by Spark's skew handling; a file's own lines bound what is gathered for it.
    """

    @F.arrow_udf("binary")
    def profile(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_profile(t) for t in text.to_pylist()], pa.binary())

    lines = files.select("file_id", profile("text").alias("profile")).groupBy("file_id").agg(F.max("profile").alias("profile"))
    symbol = F.col("symbol") if "symbol" in regions.columns else F.lit(None).cast("string").alias("symbol")
    usable = (
        regions.select("region_id", "file_id", "repo", language_of(F.col("language"), F.col("file_path")).alias("language"), "start_line", "end_line", symbol)
        .where("start_line >= 1 AND end_line >= start_line")
        .dropDuplicates(["region_id"])
    )
    general = limits.where("repo IS NULL").groupBy("language").agg(F.max_by(F.struct("max_chunk_lines", "overlap_lines"), "max_chunk_lines").alias("g"))
    special = limits.where("repo IS NOT NULL").groupBy("language", "repo").agg(F.max_by(F.struct("max_chunk_lines", "overlap_lines"), "max_chunk_lines").alias("s"))
    rows = usable.join(general, "language", "left").join(special, ["language", "repo"], "left")
    rows = rows.withColumn("l", F.coalesce("s", "g")).where("l.max_chunk_lines IS NOT NULL")
    # Bounds of a file's regions: at most as many as it has lines, so neither set outgrows the file. They lower the prices
    # once for each file; a region then takes its part of them, and nothing as long as a file is repeated for each region.
    named = F.col("symbol") != ""
    spots = usable.select("file_id", F.explode(F.array(F.col("start_line") - 2, F.col("end_line") - 1)).alias("at"), F.coalesce(named, F.lit(False)).alias("named"))
    bounds = spots.groupBy("file_id").agg(F.collect_set("at").alias("bounds"), F.collect_set(F.when(F.col("named"), F.col("at"))).alias("named"))

    @F.arrow_udf("binary")
    def priced(prof: pa.Array, bounds: pa.Array, named: pa.Array) -> pa.Array:
        return pa.array([cut_prices(*row).tobytes() for row in zip(prof.to_pylist(), bounds.to_pylist(), named.to_pylist())], pa.binary())

    prices = lines.where("profile IS NOT NULL").join(bounds, "file_id").select("file_id", priced("profile", "bounds", "named").alias("profile"))
    n = F.length("profile")
    sized = rows.join(prices, "file_id").withColumn("first", F.least("start_line", n)).withColumn("last", F.least("end_line", n))
    over = sized.where((n >= 1) & (F.col("last") - F.col("first") + 1 > F.col("l.max_chunk_lines")))
    part = over.select("region_id", "first", "last", "l", F.substring("profile", F.col("first"), F.col("last") - F.col("first") + 1).alias("price"))
    # A byte of prices costs far more time than other bytes: as many parts as the session shuffles into, whatever their size.
    part = part.repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region_id")

    @F.arrow_udf("array<struct<start_line:int,end_line:int>>")
    def pieces(first: pa.Array, last: pa.Array, limit: pa.Array, overlap: pa.Array, price: pa.Array) -> pa.Array:
        out = []
        for a, b, lim, lap, p in zip(*(x.to_pylist() for x in (first, last, limit, overlap, price))):
            found = split_lines(a, b, lim, lap or 0, np.frombuffer(p, np.uint8).astype(float))
            out.append([{"start_line": s, "end_line": e} for s, e in found])
        return pa.array(out, pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32())])))

    cut = part.select("region_id", pieces("first", "last", "l.max_chunk_lines", "l.overlap_lines", "price").alias("p"))
    return cut.select("region_id", F.size("p").alias("n_pieces"), F.posexplode("p").alias("pos", "x")).select(
        "region_id", (F.col("pos") + 1).alias("piece_no"), "x.start_line", "x.end_line", "n_pieces"
    )
