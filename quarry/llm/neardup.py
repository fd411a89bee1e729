"""Near-duplicate documents by HyperMinHash, banding, and exact confirmation.

A sketch has ``REGISTERS`` registers; each keeps, for the least of one hash function's values
over a document's shingles, its leading zeros and the mantissa bits that follow. Documents
with one set of shingles form a class. Classes that agree in a band of registers are joined
into families, at the cost of one link per class and band. Within families, pairs are
compared a block at a time, first by the collision-corrected estimate from the registers and
then exactly on full sets; a block gives a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm import winnow
from quarry.llm.common import Scratch, shield, tidied, words_of
from quarry.llm.substrings import hashes

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Bands that are looked at before the others.
FIRST_BANDS = 8
MANTISSA = 10
#: Chance that a link at the threshold shares no band; 1.2e-7 at 80 percent.
MISSED = 1e-6
#: Classes, and bytes of payload, of one block.
BLOCK_ROWS, BLOCK_BYTES = 512, 6_000_000
#: Tasks over which a family's members of about one size are dealt before they know their blocks.
SALTS = 64
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096
_ODD = (winnow.mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * winnow.BASE) | np.uint64(1)).tolist()


def shingle_sets(words: list[list[bytes]], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's shingles; a shorter document is one shingle as a whole."""
    units = np.concatenate([hashes(w) for w in words]) if words else np.zeros(0, np.uint64)
    h = winnow.mixed(winnow.Rolling(units).windows(width))
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit numbers."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set that is not empty."""
    sets = [s for s in sets if len(s)]
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sets:
        return out
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    whole = np.concatenate(sets)
    product = np.empty_like(whole)
    for k, odd in enumerate(_ODD):
        np.multiply(whole, np.uint64(odd), out=product)
        least = np.minimum.reduceat(product, starts)
        zeros = _bits(least)
        rest = (least << np.minimum(zeros, np.uint64(63))) << np.uint64(1)  # without the leading one
        out[:, k] = (zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of sets of n and m other shingles agree by themselves.

    A minimum with z leading zeros has about the density n * exp(-n * 2**-z); cells of that
    size are 2**-MANTISSA of their binade.
    """
    z = np.arange(0, 50)
    hi, lo = 2.0**-z, 2.0 ** -(z + 1)
    own = np.exp(-np.multiply.outer(n, lo)) - np.exp(-np.multiply.outer(n, hi))
    other = np.exp(-np.multiply.outer(m, lo)) - np.exp(-np.multiply.outer(m, hi))
    return (own * other).sum(-1) * 2.0**-MANTISSA


def estimates(sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of all pairs of a block, corrected for colliding registers."""
    n = len(sketches)
    same = np.zeros((n, n), np.int32)
    for k in range(sketches.shape[1]):
        same += sketches[:, k][:, None] == sketches[:, k]
    by_size = np.round(np.log2(np.maximum(sizes, 1))).astype(int)
    at = 2.0 ** np.arange(by_size.max() + 1)
    chance = collisions(at[:, None], at[None, :])[by_size[:, None], by_size]
    return (same / sketches.shape[1] - chance) / (1 - chance)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    new = np.concatenate(([True], whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(new), len(whole)))
    column = np.cumsum(new) - 1
    shared = count > 1  # a shingle of one set alone adds nothing
    names = np.cumsum(shared) - 1
    keep = shared[column] if len(column) else np.zeros(0, bool)
    owner, column = owner[keep], names[column[keep]]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(names[-1]) + 1 if len(names) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, first member) of each connected part of a symmetric matrix."""
    n = len(linked)
    left = np.ones(n, bool)
    out = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            out += [(int(k), root) for k in front]
    return out


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, label) for every end of ``edges`` (a, b): the least end that is reachable. All in Spark, a table a round."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "c"), "c").select("c", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("c").alias("next"), F.col("label").alias("further"))
        new = new.join(jump, "next").select("c", F.least("next", "further").alias("new"), "label")
        stepped = scratch.keep(new, f"{name}-{k + 1}")
        moved = not stepped.filter("new <> label").isEmpty()
        labels = stepped.select("c", F.col("new").alias("label"))
        if k:
            scratch.drop(f"{name}-{k}")
        k += 1
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels


def blocks(members: DataFrame, size: Column, shingles: Column, percent: int) -> DataFrame:
    """``members`` (family, c, ...) dealt into pairs of blocks: adds i and j; a member of block k is in pairs (i, j) with i = k or j = k.

    A family of more than one block is first cut into cells by number of shingles. Sets as similar as
    ``percent`` differ in size by a factor of 100 / percent at most, so they are in one cell or in neighbours,
    and only blocks of such cells meet. Members are dealt out by a salt, so that no task has all of a family.
    """
    cell = F.floor(F.log(shingles) / F.lit(math.log(1.001 * 100 / percent))).cast("long")
    own = members.withColumns({"cell": cell, "salt": F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")})
    salted = own.groupBy("family", "cell", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    cells = salted.groupBy("family", "cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, of: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(of / BLOCK_BYTES))
    family = Window.partitionBy("family")  # a row for each cell
    up = family.orderBy("cell")
    beside = lambda f, step: F.when(f("cell").over(up) == F.col("cell") + step, f("own").over(up))
    laid = cells.withColumns({"own": parts(F.col("n"), F.col("bytes")), "all": F.sum("n").over(family), "parts": parts(F.sum("n").over(family), F.sum("bytes").over(family))})
    laid = laid.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)}).filter("all > 1").select("family", "cell", "parts", "own", "below", "above")
    placed = own.join(salted.select("family", "cell", "salt").join(laid, ["family", "cell"]), ["family", "cell", "salt"])

    name = lambda c, k: c * F.lit(1 << 32) + k
    me = name(F.col("cell"), F.pmod(F.xxhash64("c"), F.col("own")))
    of_cell = lambda n, step: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: name(F.col("cell") + step, k))).otherwise(F.array().cast("array<long>"))
    others = F.array_remove(F.concat(of_cell(F.col("own"), 0), of_cell(F.col("below"), -1), of_cell(F.col("above"), 1)), me)
    met = F.when(F.col("parts") == 1, F.array(F.lit(-1).cast("long"))).when(F.size(others) > 0, others).otherwise(F.array(me))
    mine = F.when(F.col("parts") == 1, F.lit(-1).cast("long")).otherwise(me)
    pairs = placed.withColumn("me", mine).withColumn("other", F.explode(met))
    return pairs.withColumns({"i": F.least("me", "other"), "j": F.greatest("me", "other")}).select(*members.columns, "i", "j")


def forests(members: DataFrame, size: Column, shingles: Column, percent: int, linked: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Spanning forests (a, b) of the links in each pair of blocks."""
    dealt = blocks(members, size, shingles, percent)
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "c")

    def solve(rows: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(rows, ignore_index=True)
        c = pdf["c"].to_numpy()
        found = forest(linked(pdf))
        return pd.DataFrame({"a": [c[x] for x, _ in found], "b": [c[y] for _, y in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in tidied(batches):
            if not len(pdf):
                continue
            new = (pdf["family"] != pdf["family"].shift()) | (pdf["i"] != pdf["i"].shift()) | (pdf["j"] != pdf["j"].shift())
            cuts = [*np.flatnonzero(new.to_numpy()), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                name = (pdf["family"].iat[a], pdf["i"].iat[a], pdf["j"].iat[a])
                if held and name != last:
                    yield solve(held)
                    held = []
                held.append(pdf.iloc[a:b])
                last = name
        if held:
            yield solve(held)

    return dealt.mapInPandas(run, "a binary, b binary")


def _set_name(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sets_of(pdf: pd.DataFrame, width: int):
    for a, b in winnow.laid([len(t) // 4 if isinstance(t, str) else 0 for t in pdf["text"]], 500_000):
        some = pdf.iloc[a:b]
        yield some, shingle_sets([words_of(t, lower=True) for t in some["text"]], width)


def _stars(keys: DataFrame) -> DataFrame:
    """Links (a, b) from the labels in a bucket of a band to its least label."""
    leaders = keys.groupBy("band").agg(F.min("label").alias("b"), F.max("label").alias("most")).filter("b <> most").select("band", "b")
    return keys.join(leaders, "band").select(F.col("label").alias("a"), "b").filter("a <> b").distinct()


def layout(percent: int) -> tuple[int, float]:
    """Registers of a band, and the least estimate that is looked at, for a threshold.

    As many registers as leave a link at the threshold without a common band with a chance of at most
    MISSED. Estimates have a standard error of at most 0.036; seven of them are left.
    """
    if not 20 <= percent <= 100:
        raise ValueError("percent must be 20 to 100")
    share = percent / 100
    fit = [r for r in range(1, ROWS + 1) if (1 - share**r) ** (REGISTERS // r) <= MISSED]
    return fit[-1], share - 7 * 0.036


def _families(classes: DataFrame, scratch: Scratch, rows: int = ROWS) -> DataFrame:
    """(c, family) of classes that agree in a band with another one, directly or by others.

    The first bands join most of a family; in the others it then counts as one label, so that
    its members do not link to a leader in each of all bands.
    """
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sketch", 2 * rows * k + 1, 2 * rows))
    keys = lambda df, some: df.select("label", F.explode(F.array(*[band(k) for k in some])).alias("band"))
    first = components(_stars(keys(classes.select(F.col("c").alias("label"), "sketch"), range(FIRST_BANDS))), scratch, "first")
    rooted = classes.select("c", "sketch").join(first, "c", "left").select("c", "sketch", F.col("label").isNotNull().alias("linked"), F.coalesce("label", "c").alias("label"))
    second = components(_stars(keys(rooted, range(FIRST_BANDS, REGISTERS // rows))), scratch, "second")
    top = second.select(F.col("c").alias("label"), F.col("label").alias("top"))
    found = rooted.select("c", "label", "linked").join(top, "label", "left").filter("linked OR top IS NOT NULL")
    return scratch.keep(found.select("c", F.coalesce("top", "label").alias("family")), "families")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key, n_shingles, component_id and kept.

    Documents are linked where 100 * (size of the intersection) >= percent * (size of the
    union) of their sets of ``shingle_words``-word shingles (A-Z lower-cased). A document with
    fewer words is one shingle; one without words is linked with nothing. component_id is the
    smallest id that is reachable; ``kept`` marks its document. Null ids are never the
    smallest; where all ids of a component are null, each is kept. Repeated rows are linked.
    """
    rows_of_band, least = layout(percent)
    scratch = Scratch(docs.sparkSession)
    rows = winnow.keyed(docs, id_col, text_col)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for some, sets in _sets_of(pdf, shingle_words):
                own = iter(registers(sets))
                yield pd.DataFrame({"doc_id": some["doc_id"], "key": some["key"], "n_shingles": [len(s) for s in sets], "c": [_set_name(s) for s in sets], "sketch": [next(own).tobytes() if len(s) else None for s in sets]})

    told = scratch.keep(rows.mapInPandas(sketch, "doc_id long, key long, n_shingles long, c binary, sketch binary"), "told")
    classes = scratch.keep(told.filter("c IS NOT NULL").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    families = _families(classes, scratch, rows_of_band)

    def similar(pdf: pd.DataFrame) -> np.ndarray:
        sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), -1)
        return estimates(sketches, pdf["n"].to_numpy()) >= least

    members = families.join(classes.select("c", "n", "sketch"), "c")
    close = components(forests(members, F.length("sketch"), F.col("n"), percent, similar), scratch, "close")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tidied(batches):
            for some, own in _sets_of(pdf, shingle_words):
                yield pd.DataFrame({"family": some["family"], "c": some["c"], "hashes": [s.tobytes() for s in own]})

    wanted = close.select("c", F.col("label").alias("family")).join(classes.select("c", F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key")), "c")
    texts = rows.join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("family", "c", "text")
    full = scratch.keep(texts.mapInPandas(sets, "family binary, c binary, hashes binary").dropDuplicates(["c"]), "sets")

    def confirmed(pdf: pd.DataFrame) -> np.ndarray:
        own = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        both = intersections(own)
        size = np.diagonal(both)
        return 100 * both >= percent * (size[:, None] + size - both)

    linked = components(forests(full, F.length("hashes"), F.length("hashes") / 8, percent, confirmed), scratch, "linked")
    of_class = classes.select("c", F.col("first.doc_id").alias("lo")).join(linked, "c", "left").select("c", "lo", F.coalesce("label", "c").alias("label"))
    least = of_class.groupBy("label").agg(F.min("lo").alias("component_id"))
    found = of_class.join(least, "label").select("c", "component_id")
    out = told.drop("sketch").join(found, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return scratch.finish(out.select("doc_id", "key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")))


def dedup(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, and one row of it.

    A row without words is a component of its own and stays, as do rows with null ids whose component has no other ids.
    Rows with equal id and text count as one. Further columns stay as they are; an empty table gives no rows.
    """
    docs, back = shield(docs, id_col, text_col)
    found = near_duplicates(docs, shingle_words=shingle_words, percent=percent, id_col=id_col, text_col=text_col)
    stay = found.filter("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_copies")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    joined = docs.withColumn("_key0", key).join(stay, (F.col("_key0") == F.col("_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")))
    once = joined.filter("_copies = 1")
    more = joined.filter("_copies > 1").dropDuplicates(["_id", "_key"])
    return once.unionByName(more).select(*docs.columns).withColumnsRenamed(back)
