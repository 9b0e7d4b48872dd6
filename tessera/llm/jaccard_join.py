"""N-gram Jaccard join: groups of documents linked by T-occurrence search with DivideSkip.

A text's set is its distinct 3-word shingles (as 64-bit hashes); fewer words are one shingle,
and no words an empty set, linked with nothing.  Sets link at Jaccard >= num/den.

1. Shingles are put in one order, from rare to frequent ones.  Sets of sizes a and b that link
   share so many that the first n - required + 1 of each in that order have one in common, so
   whatever could link shares a shingle of these prefixes, the rare end of its set.  Counts cover
   all documents: buckets of texts send the codes of their shingles in ranges, and get back which
   of them occur elsewhere too, and how often.  A shingle that occurs once links nothing.
   Each document is joined to the least document of each prefix shingle (a star, never all
   pairs; a bucket does so for what it sees before it sends one row for each shingle), and the
   components of these stars are blocks: documents of different blocks cannot link.
2. Documents with equal sets form a class; its least doc_id stands for it from here on.
3. Only such documents in blocks send their sets, once.  In a block an inverted index of shingles
   is searched for each document: the short lists are merged with a heap that skips, the long
   ones probed by bisection, until the required overlap is reached.  A document that has joined
   a component leaves that component's postings out of what it still searches.
4. A block of more than `block_docs` sets or `BLOCK_SHINGLES` shingles is cut into chunks that all hold the block's least
   document.  What is not connected to it then is searched for against all chunks.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import BLANKS, U64, flat, mix, slices, window_hashes, words
from .lineage import checkpoint, components

#: Sets of a block, and shingles of them, that are searched as a whole.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 2_000_000
#: Text of a bucket, and of what each range of codes stands for, at least so many ranges.
BUCKET_BYTES, RANGE_BYTES, LEAST_RANGES = 2 << 20, 48 << 20, 256
#: Weight of a probe against a merge step in DivideSkip's choice of the number of long lists.
PROBE_WEIGHT = 0.01


def required_overlap(a, b, num: int, den: int):
    """Least size of the intersection at which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


def shingle_sets(column, size: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of the rows; row and hash of each distinct shingle, by row and hash."""
    w = words(*flat(column), BLANKS, lower=True)
    hashes = w.hashes()
    at, shingles = window_hashes(hashes, w.first, size)
    rows = w.rows[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = np.array([int(np.bitwise_xor.reduce(mix(hashes[w.first[i] : w.first[i + 1]] * U64(3) + np.arange(w.counts[i], dtype=U64)))) for i in short], U64)
    rows, shingles = np.concatenate([rows, short]), np.concatenate([shingles, whole])
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    rows, shingles = rows[new], shingles[new]
    return np.bincount(rows, minlength=len(w.first) - 1), rows, shingles


def _sums(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each code."""
    low = np.bincount(codes, (values & U64(0xFFFFFFFF)).astype(float), n).astype(U64)
    high = np.bincount(codes, (values >> U64(32)).astype(float), n).astype(U64)
    return low + (high << U64(32))


def prefix_sizes(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of its first shingles a set must show: the least partner it can link with has num/den of its size."""
    return sizes - required_overlap(sizes, -(-num * sizes // den), num, den) + 1


def length_partitions(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Partitions of set sizes such that only sets of one partition or of two neighbouring ones can link."""
    bounds = [1]
    while bounds[-1] <= sizes.max(initial=0):
        bounds.append(bounds[-1] * den // num + 1)
    return np.searchsorted(np.array(bounds), sizes, side="right")


def codes(shingles: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range (of a power of two) and 32-bit code in it; shingles of equal codes are counted together, which changes only the order."""
    bits = ranges.bit_length() - 1
    return (shingles >> U64(64 - bits)).astype(np.int64), ((shingles >> U64(32 - bits)) & U64(0xFFFFFFFF)).astype(np.uint32)


def levels_of(blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each array of distinct codes: those that some other array has too, and the logarithm of how many have it."""
    arrays = [np.frombuffer(x, np.uint32) for x in blobs]
    every = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    level = np.log2(counts).astype(np.uint8)[inverse]
    edges = np.cumsum([0, *map(len, arrays)])
    return [(x[level[a:b] > 0], level[a:b][level[a:b] > 0]) for x, a, b in zip(arrays, edges[:-1], edges[1:], strict=True)]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _set_ids(sizes, rows, shingles) -> list[pa.Array]:
    return [_signed(_sums(rows, mix(shingles ^ U64(k)), len(sizes))) for k in (0x1F, 0x2E5D)]


def _digests(batches, sets_of):
    for batch in slices(batches, "text"):
        sets = sets_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets[0].astype(np.int64)), *_set_ids(*sets)], ["doc_id", "n", "s", "t"])


def _send_codes(sets_of, ranges: int):
    """The distinct codes of a bucket's shingles, by range, and how often more than once in the bucket."""

    def send(table: pa.Table) -> pa.Table:
        parts = [codes(sets_of(batch.column("text"))[2], ranges) for batch in slices(table.to_batches(), "text")]
        part, code = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        order = np.lexsort((code, part))
        part, code = part[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (code[1:] != code[:-1])])) if len(part) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(part)))
        part, code = part[first], code[first]
        present, start = np.unique(part, return_index=True)
        stop = np.append(start[1:], len(part)).astype(int)
        bucket = table.column("__bucket")[0].as_py()
        blobs = [code[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
        twice = [np.packbits(times[a:b] > 1).tobytes() for a, b in zip(start, stop, strict=True)]
        return pa.table([pa.array(present), pa.array(np.full(len(present), bucket)), pa.array(blobs, pa.binary()), pa.array(twice, pa.binary())], names=["part", "bucket", "codes", "twice"])

    return send


def _return_codes(table: pa.Table) -> pa.Table:
    """What each bucket must know of a range: its codes that occur more than once, with their levels."""
    blobs, twice = table.column("codes").to_pylist(), table.column("twice").to_pylist()
    # a code that a bucket has more than once counts twice
    again = [np.frombuffer(x, np.uint32)[np.unpackbits(np.frombuffer(t, np.uint8), count=len(x) // 4).astype(bool)].tobytes() for x, t in zip(blobs, twice, strict=True)]
    found = levels_of(blobs + again)[: len(blobs)]
    columns = [table.column("part"), table.column("bucket"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())]
    return pa.table(columns, names=["part", "bucket", "codes", "levels"]).filter(pa.array([len(x) > 0 for x, _ in found], pa.bool_()))


def _prefixes(sets_of, num: int, den: int, ranges: int, by_length: bool):
    """segment, u, v: the least document of each prefix shingle in the bucket (v null), and the edges to it from
    the other ones (segment any value, v not null). by_length: a shingle is another one in each partition of set
    lengths; a set shows its shingles in its own partition and in the one before."""

    def stars(table: pa.Table, known: pa.Table) -> pa.Table:
        held = []
        if table.num_rows:
            shared = {p: (np.frombuffer(c, np.uint32), np.frombuffer(x, np.uint8)) for p, c, x in zip(*(known.column(k).to_pylist() for k in ("part", "codes", "levels")), strict=True)}
            part_of = np.array(sorted(shared), np.int64)
            code_of = np.concatenate([np.zeros(0, np.uint32), *[shared[p][0] for p in part_of]])
            level_of = np.concatenate([np.zeros(0, np.uint8), *[shared[p][1] for p in part_of]])
            keys = (np.repeat(part_of, [len(shared[p][0]) for p in part_of]).astype(U64) << U64(32)) | code_of
        for batch in slices(table.to_batches(), "text"):
            sizes, rows, shingles = sets_of(batch.column("text"))
            part, code = codes(shingles, ranges)
            key = (part.astype(U64) << U64(32)) | code
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            level = np.where(keys[at] == key, level_of[at], 0) if len(keys) else np.zeros(len(key), np.uint8)
            order = np.lexsort((shingles, level, rows))
            rows, shingles, level = rows[order], shingles[order], level[order]
            place = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
            chosen = (place < prefix_sizes(sizes, num, den)[rows]) & (level > 0)
            shown, doc = shingles[chosen], batch.column("doc_id").to_numpy()[rows[chosen]]
            if by_length:
                partition = length_partitions(sizes, num, den)[rows[chosen]].astype(U64)
                shown, doc = np.concatenate([mix(shown ^ mix(partition - U64(k))) for k in (0, 1)]), np.tile(doc, 2)
            held.append((shown, doc))
        segment, doc = (np.concatenate([np.zeros(0, x), *[h[k] for h in held]]) for k, x in ((0, U64), (1, np.int64)))
        order = np.lexsort((doc, segment))
        segment, doc = segment[order], doc[order]
        first = np.ones(len(segment), bool)
        first[1:] = segment[1:] != segment[:-1]
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        other = doc != least
        edges = np.unique(np.stack([doc[other], least[other]]), axis=1)
        return pa.table(
            [
                pa.concat_arrays([_signed(segment[first]), _signed(mix(edges[0].astype(U64)))]),
                pa.array(np.concatenate([doc[first], edges[0]])),
                pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(edges[1])]),
            ],
            names=["segment", "u", "v"],
        )

    return stars


def _meet(batches):
    """Edges from each document to the least one of its shingle, of rows sorted by segment and u; edges pass."""
    last, least_of_last = None, 0
    for batch in batches:
        is_edge = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
        segment, doc = batch.column("segment").to_numpy()[~is_edge], batch.column("u").to_numpy()
        found = [np.stack([doc[is_edge], batch.column("v").drop_null().to_numpy()])]
        doc = doc[~is_edge]
        if len(doc):
            first = np.concatenate([[segment[0] != last], segment[1:] != segment[:-1]])
            start = np.maximum.accumulate(np.where(first, np.arange(len(doc)), -1))
            least = np.where(start < 0, least_of_last, doc[start])
            last, least_of_last = segment[-1], least[-1]
            other = doc != least
            found.append(np.stack([doc[other], least[other]]))
        u, v = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


class Filter:
    """A bit for each of `bits` hashes of ids: whether a document may be among some set of them."""

    def __init__(self, ids: DataFrame, most_bits: int = 1 << 26):
        n = ids.count()
        self.bits = 1 << min(max(16, (8 * n).bit_length()), most_bits.bit_length() - 1)
        at = F.pmod(F.xxhash64("doc_id"), F.lit(self.bits))
        cells = ids.select(F.shiftright(at, 5).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(32)).cast("int")).alias("bit"))
        found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.cells = np.zeros(self.bits >> 5, np.uint32)
        self.cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy()

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return (self.cells[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _sets(batches, sets_of):
    for batch in slices(batches, "text"):
        sizes, _, shingles = sets_of(batch.column("text"))
        stops = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 8
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(shingles.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw], ["doc_id", "shingles"])


def occurring(lists: list[list[int]], needed: int):
    """DivideSkip: positions found in at least `needed` of the ascending lists, and in how many, at least
    as far as that; the long lists are probed for what the short ones let pass."""
    lists.sort(key=len)
    longest = len(lists[-1])
    n_long = min(needed - 1, len(lists) - 1, int(needed / (PROBE_WEIGHT * np.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least = needed - n_long
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < needed:
                    break
                at = bisect_left(x, value)
                count += at < len(x) and x[at] == value
            if count >= needed:
                yield value, count
            jump = value + 1
        else:
            while heap and len(popped) < least - 1:  # these cannot reach it before the heap's next value
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            jump = max(heap[0][0], value + 1)
        for _, i, at in popped:
            at = bisect_left(short[i], jump, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))


def links(ids: list[int], sets: list[np.ndarray], asks: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Linked pairs, of which at least one asks, that connect all sets which such pairs connect."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = [len(sets[i]) for i in order]
    component = np.arange(len(order))
    found, index, all_of, hub = [], {}, {}, None

    def join(i: int, j: int) -> bool:
        shared = np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True).size
        if shared < required_overlap(sizes[i], sizes[j], num, den):
            return False
        component[component == component[i]] = component[j]
        found.append((ids[order[i]], ids[order[j]]))
        return True

    for i, k in enumerate(order):
        shingles = sets[k].tolist()
        n = sizes[i]
        low = bisect_left(sizes, -(-num * n // den))
        needed = required_overlap(n, max(sizes[low], -(-num * n // den)), num, den)
        source = all_of if asks[k] else index
        postings = [np.frombuffer(x, np.int64) for x in map(source.get, shingles) if x and x[-1] >= low]
        if hub is not None and hub >= low and (asks[k] or asks[order[hub]]) and len(postings) >= needed:
            join(i, hub)  # members of a large component mostly link with the one that the last set linked with
        after = low - 1
        while len(postings) >= needed:
            # what is in another component, and not yet looked at
            lists = [y.tolist() for x in postings if len(y := x[(x > after) & (component[x] != component[i])])]
            if len(lists) < needed:
                break
            after = next((j for j, _ in occurring(lists, needed) if join(i, j)), None)
            if after is None:
                break
            hub = after
        postings.clear()  # a view keeps its list from growing
        for x in shingles:
            all_of.setdefault(x, array("q")).append(i)
            if asks[k]:
                index.setdefault(x, array("q")).append(i)
    return found


def _block_links(num: int, den: int):
    def find(table: pa.Table) -> pa.Table:
        rows = {}
        for doc_id, asks, raw in zip(table.column("doc_id").to_pylist(), table.column("asks").to_pylist(), table.column("shingles").to_pylist(), strict=True):
            rows[doc_id] = (rows[doc_id][0] or asks if doc_id in rows else asks, raw)
        pairs = links(list(rows), [np.frombuffer(x, U64) for _, x in rows.values()], [a for a, _ in rows.values()], num, den)
        return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})

    return find


def jaccard_components(docs: DataFrame, num: int = 9, den: int = 10, sets_of=shingle_sets, block_docs: int = BLOCK_DOCS, by_length: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id (least doc_id that links reach, itself included).

    Null and empty texts have 0 shingles and are alone.  Rows of one doc_id count as one document
    with several sets.  Rows whose doc_id is null link with nothing and have a null component_id.
    Repeated rows are in one component.  An empty table gives an empty table.  by_length parts sets by
    their lengths before they are dealt into blocks, which the links do not show.
    """
    docs = docs.select("doc_id", "text")
    light = checkpoint(docs.mapInArrow(lambda b: _digests(b, sets_of), "doc_id long, n long, s long, t long"))
    known = docs.filter("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(LEAST_RANGES.bit_length() - 1, (size // RANGE_BYTES).bit_length())
    dealt = known.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BUCKET_BYTES)))))
    sent = dealt.groupBy("__bucket").applyInArrow(_send_codes(sets_of, ranges), "part long, bucket long, codes binary, twice binary")
    returned = sent.groupBy("part").applyInArrow(_return_codes, "part long, bucket long, codes binary, levels binary")
    prefixes = dealt.groupBy("__bucket").cogroup(returned.groupBy("bucket")).applyInArrow(_prefixes(sets_of, num, den, ranges, by_length), "segment long, u long, v long")
    stars = prefixes.repartition("segment").sortWithinPartitions("segment", "u").mapInArrow(_meet, "u long, v long")
    groups = light.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s", "t", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    spoken_for = light.join(groups.filter("copies > 1").select("s", "t", "n", "least"), ["s", "t", "n"]).filter("doc_id <> least").select("doc_id").distinct()
    blocks = checkpoint(components(stars).withColumnsRenamed({"id": "doc_id", "label": "block"}).join(spoken_for, "doc_id", "left_anti"))

    may_be = docs.sparkSession.sparkContext.broadcast(Filter(blocks.select("doc_id")))
    bits = may_be.value.bits

    def chosen(batches):
        for batch in batches:
            keep = may_be.value(batch.column("at").to_numpy())
            if keep.any():
                yield from _sets([batch.filter(pa.array(keep))], sets_of)

    sets = known.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at")).mapInArrow(chosen, "doc_id long, shingles binary")
    in_size = F.greatest(F.count("*") / F.lit(block_docs), F.sum("size") / F.lit(BLOCK_SHINGLES))
    sized = blocks.join(light.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("n").alias("size")), "doc_id")
    counts = sized.groupBy("block").agg(F.ceil(in_size).cast("long").alias("chunks"))
    placed = checkpoint(sized.join(counts, "block").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("chunks"))))
    members = placed.join(sets, "doc_id")
    everywhere = F.when(F.col("doc_id") == F.col("block"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("own"))
    chunks = members.select("block", F.explode(everywhere).alias("chunk"), "doc_id", F.lit(True).alias("asks"), "shingles")
    found = checkpoint(chunks.groupBy("block", "chunk").applyInArrow(_block_links(num, den), "u long, v long"))

    if placed.filter("chunks > 1").limit(1).count():
        joined = components(found)
        cut = placed.filter("chunks > 1").join(joined.withColumnsRenamed({"id": "doc_id"}), "doc_id", "left")
        of_block = joined.select(F.col("id").alias("block"), F.col("label").alias("main"))
        cut = checkpoint(cut.join(of_block, "block", "left").withColumn("rest", ~F.coalesce(F.col("label"), F.col("doc_id")).eqNullSafe(F.coalesce("main", "block"))))
        rest = cut.filter("rest").groupBy("block").agg(F.ceil(in_size).cast("long").alias("asking"))
        asked = cut.join(rest, "block").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.col("asking")))
        there = asked.select("block", "doc_id", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("part"), F.col("own").alias("chunk"))
        asking = asked.filter("rest").select("block", "doc_id", F.lit(True).alias("asks"), "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
        more = there.unionByName(asking).join(sets, "doc_id").groupBy("block", "part", "chunk").applyInArrow(_block_links(num, den), "u long, v long")
        found = found.unionByName(more)

    labels = components(found)
    renamed = groups.join(labels.select(F.col("id").alias("least"), "label"), "least", "left").filter("copies > 1 OR label IS NOT NULL").select("s", "t", "n", F.coalesce("label", "least").alias("label"))
    return light.join(renamed, ["s", "t", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), bi AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, bi.y FROM r JOIN bi ON r.b = bi.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
