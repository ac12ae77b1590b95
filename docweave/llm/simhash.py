"""Operator 5, SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits, split into SEGMENTS = distance + 1 segments on a ring. If two fingerprints
differ in at most `distance` bits, then by the pigeonring principle some segment starts a chain in which
the first l segments together differ in at most l * distance / SEGMENTS bits, for every l: 0 bits in the
first segment, at most 1 in the first two, at most 2 in three, and so on. So each distinct fingerprint is
filed, for each start, under its first CHAIN segments and under all versions of them that keep to these
budgets; two fingerprints that link meet in a bucket. In a bucket, a pair must keep to the budgets of the
longer chains before its full distance is taken.

Hot groups: equal fingerprints are one node from the start (minimum by partial aggregation). Within a
bucket, a search takes away what it reaches, so a dense group of k fingerprints costs about k steps and
gives k - 1 links, never all pairs, and none of its members many; that loses no connection. A bucket over BUCKET_ROWS is not searched
but filed anew, losslessly, under chains longer by a segment (up to LONGEST). A bucket that is too large even
there is cut into blocks, and each two blocks are searched together in a task of their own. Links become
components in rounds.

Defined results: texts without words (null, empty) have fingerprint zero and so are linked with each
other; repeated rows get the same result each; rows whose doc_id is null have no say in a component's
smallest id; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, groups_of_text, stored, table, text_of
from docweave.llm.components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Segments of a chain that rows are filed under at first.
CHAIN, LONGEST = 2, 3
#: From so many distinct fingerprints on, a segment more.
MANY = 1 << 30
BUCKET_ROWS = 50_000
#: Links that a fingerprint gives within what one search reaches.
FAN = 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Of one text, as an unsigned number."""
    import numpy as np
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and blanks of ASCII
    if not found:
        return 0
    size = min(words, len(found))
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - size + 1].tolist()
    view = memoryview(whole)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, and keys: columns of whole numbers) as doc_id, fp (the fingerprint's 64 bits as a signed number), keys."""

    def run(batches):
        import pyarrow as pa

        for group in groups_of_text(arrow_rows(batches, "doc_id", "text", *keys)):
            doc_id, texts, *more = zip(*group, strict=True)
            fps = [fingerprint(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array([x - (x >> 63 << 64) for x in fps], pa.int64()), *(pa.array(x, pa.int64()) for x in more)], ["doc_id", "fp", *keys])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *keys).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keys)))


def segments(distance: int = DISTANCE) -> list[int]:
    """The bits of each segment, as masks."""
    n = distance + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def budget(length: int, distance: int) -> int:
    """The most bits that the first `length` segments of a chain may differ in."""
    return length * distance // (distance + 1)


def versions(start: int, chain: int, distance: int = DISTANCE) -> list[int]:
    """The bits to flip for all versions of a chain's segments that keep to the budgets; 0 comes first."""
    masks, flips = segments(distance), [(0, 0)]
    for length in range(1, chain):
        bits = [1 << b for b in range(64) if masks[(start + length) % len(masks)] >> b & 1]
        for_step = []
        for flip, used in flips:
            ways = [(0, 0)]
            for bit in bits:
                ways += [(w | bit, n + 1) for w, n in ways if used + n < budget(length + 1, distance)]
            for_step += [(flip | w, used + n) for w, n in ways]
        flips = for_step
    return sorted((f for f, _ in flips), key=lambda f: (f != 0, f))


def filed(fps: DataFrame, chain: int, distance: int = DISTANCE) -> DataFrame:
    """fps (fp, and start if only that one counts) as start, key, fp, exact."""
    masks = segments(distance)
    n = len(masks)
    signed = lambda x: x - (x >> 63 << 64)
    parts = []
    for start in range(n):
        keep = reduce(lambda a, b: a | b, (masks[(start + k) % n] for k in range(min(chain, n))))
        flips = F.array(*(F.lit(signed(f)).cast("long") for f in versions(start, min(chain, n), distance)))
        own = fps.where(F.col("start") == start) if "start" in fps.columns else fps
        parts.append(own.select(F.lit(start).cast("int").alias("start"), "fp", F.explode(flips).alias("flip")).select("start", F.col("fp").bitwiseAND(F.lit(signed(keep)).cast("long")).bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).alias("exact")))
    return reduce(DataFrame.unionAll, parts)


def search(fps, start: int, distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected among the fps (an array, unsigned) by pairs within the distance whose chain from this start keeps to the budgets.

    What a search reaches is linked as a tree of FAN branches a node and not with the first one, so that no fingerprint gets very many links.
    """
    import numpy as np

    masks, left = segments(distance), np.unique(fps)
    n = len(masks)
    chains = [np.uint64(reduce(lambda a, b: a | b, (masks[(start + k) % n] for k in range(length)))) for length in range(1, n)]
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo, reached = [root], [int(root)]
        while todo and len(left):
            at = todo.pop()
            differ = left ^ at
            near = np.flatnonzero(np.bitwise_count(differ & chains[0]) <= budget(1, distance))
            for length in range(2, n):
                near = near[np.bitwise_count(differ[near] & chains[length - 1]) <= budget(length, distance)]
            near = near[np.bitwise_count(differ[near]) <= distance]
            if len(near):
                for x in left[near]:
                    yield reached[(len(reached) - 1) // FAN], int(x)
                    reached.append(int(x))
                    todo.append(x)
                left = np.delete(left, near)


def search_buckets(rows: DataFrame, distance: int = DISTANCE, most: int = BUCKET_ROWS, all_of_them: bool = False) -> DataFrame:
    """rows of filed() as links a, b; or, of buckets over `most` rows, start, key and a to file anew, unless all_of_them are to be searched."""
    rows = rows.repartition("start", "key", *(c for c in ("part",) if c in rows.columns)).sortWithinPartitions("start", "key", *(c for c in ("part",) if c in rows.columns), F.desc("exact"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def given(kind, start, key, a, b):
            cols = [pa.array(kind, pa.bool_()), pa.array(start, pa.int32()), pa.array(key, pa.int64()), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))]
            return pa.RecordBatch.from_arrays(cols, ["link", "start", "key", "a", "b"])

        held_at, held, over = None, [], False  # the bucket that is not complete yet

        def done():
            if held_at is None or over:
                return None
            fps = np.concatenate(held)
            found = list(search(fps, held_at[0], distance)) if len(fps) > 1 else []
            return given([True] * len(found), [held_at[0]] * len(found), [0] * len(found), [a for a, _ in found], [b for _, b in found]) if found else None

        for batch in batches:
            names = [c for c in ("start", "key", "part") if c in batch.schema.names]
            at_of = [batch.column(c).to_numpy() for c in names]
            fp, exact = batch.column("fp").to_numpy().view(np.uint64), batch.column("exact").to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            edge = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in at_of])])
            ends = np.r_[edge[1:], len(fp)]
            # In the middle of a batch only buckets with an exact row and another one count; the first and the last may go on beyond it.
            count = (ends - edge > 1) & exact[edge]
            count[0] = count[-1] = True
            links: tuple[list, list, list, list] = ([], [], [], [])
            for k in np.flatnonzero(count):
                i, j = edge[k], ends[k]
                at = tuple(int(x[i]) for x in at_of)
                if 0 < k < len(edge) - 1:
                    if j - i <= most or all_of_them:
                        for a, b in search(fp[i:j], at[0], distance):
                            for column, value in zip(links, (at[0], 0, a, b), strict=True):
                                column.append(value)
                    else:
                        yield given([False] * (j - i), [at[0]] * (j - i), [at[1]] * (j - i), fp[i:j], fp[i:j])
                    continue
                if at != held_at:
                    if (out := done()) is not None:
                        yield out
                    held_at, held, over = (at, [], False) if exact[i] else (None, [], False)
                if held_at is None:
                    continue
                held.append(fp[i:j].copy())
                if not all_of_them and (over or sum(map(len, held)) > most):
                    fps, over, held = np.concatenate(held), True, []
                    yield given([False] * len(fps), [at[0]] * len(fps), [at[1]] * len(fps), fps, fps)
            if links[0]:
                yield given([True] * len(links[0]), *links)
        if (out := done()) is not None:
            yield out

    return rows.mapInArrow(run, "link boolean, start int, key long, a long, b long")


def in_parts(large: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """Buckets (start, key, fp) that are too large for one task, as parts of about `most` rows: blocks by hash, and a part for each two of them (and each one), so that any two rows meet in a part."""
    half = max(1, most // 2)
    blocks = large.groupBy("start", "key").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = large.join(blocks, ["start", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # With more than one block, a block's own pairs are in any part that it is in.
    rows = rows.where((F.col("own") != F.col("other")) | (F.col("blocks") == 1))
    part = F.least("own", "other") * F.col("blocks").cast("long") + F.greatest("own", "other")
    return rows.select("start", "key", part.alias("part"), "fp", F.lit(True).alias("exact"))


def fingerprint_links(fps: DataFrame, rows: int, distance: int = DISTANCE, chain: int = CHAIN, most: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all of the distinct fps (fp) that are within the distance."""
    chain += rows >= MANY
    links, todo = [], fps
    longest = min(LONGEST, distance + 1)
    for length in range(min(chain, longest), longest + 1):
        found = stored(search_buckets(filed(todo, length, distance), distance, most))
        links.append(found.where("link").select("a", "b"))
        large = found.where("not link").select("start", "key", F.col("a").alias("fp")).distinct()
        todo = large.select("start", "fp").distinct()
        if large.isEmpty():
            break
        if length == longest:
            links.append(stored(search_buckets(in_parts(stored(large), most), distance, most, True)).select("a", "b"))
    return reduce(DataFrame.unionAll, links).distinct()


def smallest_of(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """nodes (distinct fp, least) as fp, smallest: the smallest least of its component."""
    labels = components(fingerprint_links(nodes.select("fp"), nodes.count(), distance))
    linked = labels.join(nodes, F.col("node") == F.col("fp")).select("fp", "label", "least")
    smallest = linked.groupBy("label").agg(F.min("least").alias("smallest"))
    return nodes.join(linked.join(smallest, "label").select("fp", "smallest"), "fp", "left").select("fp", F.coalesce("smallest", "least").alias("smallest"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text) as doc_id, fp, component_id."""
    rows = stored(fingerprints(docs, words))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = smallest_of(nodes, distance).withColumnRenamed("smallest", "component_id")
    return rows.join(stored(found), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, keys: tuple[str, ...], words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The keys (whole numbers that tell docs' rows apart) of one row of each component: the smallest by doc_id, where null is last, and then by keys."""
    rows = fingerprints(docs, words, keys)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys))
    nodes = stored(rows.groupBy("fp").agg(least.alias("least")))
    return smallest_of(nodes, distance).select(*(F.col(f"smallest.{k}").alias(k) for k in keys)).distinct()


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
