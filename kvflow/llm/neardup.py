"""Near-duplicate pages: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Records with the same set of word runs form a class, and only one representative of each class is compared. One permutation
of the runs fills the bins of a sketch; an empty bin takes the value of the first filled one in an order of its own. Bands of
bins are bucket keys. In each bucket every member is linked with one hub only, so a bucket of n gives n - 1 candidate edges
however alike its members are, and the hub of a group differs from band to band. These edges are verified on the whole sets.
Two classes are then compared if they share a verified hub. What they have in common with the hub bounds their similarity
from both sides, which decides most pairs; only for the rest are the sets compared.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.llm import pages
from kvflow.session import bounded, discard, materialise

#: Words in a run, and the similarity from which two records are near-duplicates, as this project's data states them.
RUN_WORDS = 3
SIMILAR = 0.5
#: 64 bands of 4 bins: two records of similarity 0.6 share no band with a probability of 1.4e-4, of 0.7 under 1e-7.
BINS = 256
BAND_ROWS = 4
SEED = 7
#: Classes with candidates up to which their ids, 8 bytes each, are broadcast; more are joined by shuffle.
INVOLVED_ROWS = 1_000_000
#: Body cells and template texts that are shipped to all workers, 8 bytes each; with more, the choice of blocks is a join.
SHIPPED_KEYS = 4_000_000
#: Classes that a task remembers so as to band each once; what it forgets is banded again, which changes no result.
REMEMBERED = 1_000_000
WORD = re.compile(r"[^\W_]+")
#: ASCII signs that part words.
PARTING = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
_codes: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Runs of letters and digits of a text with entities decoded, in lower case."""
    text = html.unescape(text).lower()
    return text.translate(PARTING).split() if text.isascii() else WORD.findall(text)


def run_hashes(found: list[list[str]], size: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, run) of the distinct runs of `size` words of each list, runs as 32-bit numbers, sorted by both."""
    if len(_codes) > 500_000:
        _codes.clear()
    codes: list[int] = []
    for own in found:
        for word in own:
            code = _codes.get(word)
            if code is None:
                code = _codes[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            codes.append(code)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    n = max(len(codes) - size + 1, 0)
    values = np.array(codes, np.uint64)
    state = np.zeros(n, np.uint64)
    for i in range(size):
        state = _mix(state * np.uint64(3) + values[i : i + n] + np.uint64(i + 1))
    owner = np.repeat(np.arange(len(found), dtype=np.uint64), sizes)
    # A run belongs to the list that holds all of it.
    whole = owner[:n] == owner[len(codes) - n :] if n else np.zeros(0, bool)
    both = np.unique((owner[:n] << np.uint64(32) | state >> np.uint64(32))[whole])
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def sketches(owner: np.ndarray, runs: np.ndarray, n: int, bins: int = BINS, seed: int = SEED) -> np.ndarray:
    """One row of `bins` values for each of n sets, given as sorted (owner, run); none may be empty.

    The runs are numbers that a hash has mixed, so their own order is the permutation: the first bits name the bin, and the
    least run of each bin is its value.
    """
    bits = bins.bit_length() - 1
    column = (runs >> np.uint32(32 - bits)).astype(np.int64)
    first = np.ones(len(runs), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (column[1:] != column[:-1])
    table = np.zeros((n, bins), np.uint32)
    filled = np.zeros((n, bins), bool)
    table[owner[first], column[first]] = runs[first]
    filled[owner[first], column[first]] = True
    # Each bin has an order of all bins; an empty one takes the first filled bin in its order.
    order = np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1)
    row, column = np.nonzero(~filled)
    for turn in range(bins):
        if not len(row):
            break
        source = order[column, turn]
        hit = filled[row, source]
        table[row[hit], column[hit]] = table[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    return table


def band_keys(table: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per sketch and band."""
    n, bins = table.shape
    parts = table.reshape(n, bins // rows, rows)
    state = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        state = _mix(state * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i].astype(np.uint64))
    return state.view(np.int64)


SETS = "id bigint, cls bigint, runs array<int>, bands array<bigint>"


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sets(ids: pa.Array, texts: list[str], seen: set[int]) -> pa.RecordBatch:
    """Rows (id, cls, runs, bands) of the texts that have a run; runs and bands only of classes that this task has not seen."""
    owner, runs = run_hashes([words(t) for t in texts])
    has, start = np.unique(owner, return_index=True)
    ends = np.append(start, len(runs))[1:]
    classes = [xxhash.xxh3_64_intdigest(runs[a:b].tobytes()) - (1 << 63) for a, b in zip(start, ends, strict=True)]
    fresh = np.zeros(len(classes), bool)
    for i, cls in enumerate(classes):
        if cls not in seen:
            fresh[i] = True
            seen.add(cls)
    if len(seen) > REMEMBERED:
        seen.clear()
    sizes = np.where(fresh, ends - start, 0)
    kept = np.repeat(fresh, ends - start)
    rank = np.cumsum(fresh) - 1
    own = np.repeat(rank, ends - start)[kept]
    bands = band_keys(sketches(own, runs[kept], int(fresh.sum())))
    columns = [ids.take(pa.array(has)), pa.array(classes, pa.int64()), _lists(sizes, pa.array(runs[kept].view(np.int32))), _lists(np.where(fresh, bands.shape[1], 0), pa.array(bands.ravel()))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "cls", "runs", "bands"])


def run_sets(records: DataFrame) -> DataFrame:
    """(id, cls, runs ARRAY<INT>, bands ARRAY<BIGINT>) of the records whose main text has a run, as a table.

    cls is equal for equal sets. Of equal ones that one task reads, one row has runs and bands, the others empty lists.
    """
    seen = pages.parsed(pages.crawl_pages(records), with_text=True)
    cells, fixed = pages.model(seen)
    if cells.count() + fixed.count() <= SHIPPED_KEYS:
        keys = [np.sort(t.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)) for t in (cells, fixed)]
        shipped = seen.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: set[int] = set()
            body, template = shipped.value
            for batch in batches:
                lists = batch.column(2)
                each = lists.flatten()
                cell, other, text, repeats = (each.field(i) for i in range(4))
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                home = batch.column(1).to_numpy()[owner]
                chosen = _among(cell.to_numpy(), body)
                marks = np.flatnonzero(chosen & other.is_valid().to_numpy(zero_copy_only=False))
                chosen[marks] = _among(other.take(pa.array(marks)).to_numpy(), body)
                chosen &= ~_among(text.to_numpy() ^ home, template) | repeats.to_numpy(zero_copy_only=False)
                found: dict[int, list[str]] = {}
                at = np.flatnonzero(chosen)
                for page, part in zip(owner[at].tolist(), each.field(4).take(pa.array(at)).to_pylist(), strict=True):
                    found.setdefault(page, []).append(part)
                yield _sets(batch.column(0).take(pa.array(list(found), pa.int64())), [" ".join(parts) for parts in found.values()], known)

        wanted = F.transform("blocks", lambda b: F.struct(b["cell"], b["other"], b["text"], b["repeats"], b["body"]))
        made = seen.select("id", "home", wanted.alias("blocks")).mapInArrow(run, SETS)
    else:
        parts = pages.bodies(seen, (cells, fixed)).groupBy("page", "id").agg(F.array_sort(F.collect_list(F.struct("first", "body"))).alias("parts"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: set[int] = set()
            for batch in batches:
                yield _sets(batch.column(0), batch.column(1).to_pylist(), known)

        made = parts.select("id", F.array_join(F.transform("parts", lambda p: p["body"]), " ").alias("text")).mapInArrow(joined, SETS)
    sets = materialise(made, "runs")
    discard(seen, cells)
    return sets


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


STARS = "hub bigint, cls bigint, bucket bigint"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, cls) sorted by both: the edges (hub, member), those of buckets that may go on elsewhere with their
    bucket, and the hubs of the first and the last bucket, without a member."""
    seen: tuple[int, int] | None = None
    first: int | None = None
    for batch in batches:
        bucket, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(bucket):
            continue
        starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        # The hub has the least id turned by the bucket, so that another member is hub in another bucket.
        turn = _mix(bucket[starts].view(np.uint64)).view(np.int64)
        sizes = np.diff(np.append(starts, len(bucket)))
        hubs = np.minimum.reduceat(cls ^ np.repeat(turn, sizes), starts) ^ turn
        if seen and seen[0] == bucket[0]:
            hubs[0] = seen[1]
        if first is None:
            first = int(bucket[0])
            yield _edges(hubs[:1], None, bucket[:1])
        hub = np.repeat(hubs, sizes)
        linked = hub != cls
        yield _edges(hub[linked], cls[linked], bucket[linked], (first, int(bucket[-1])))
        seen = int(bucket[-1]), int(hubs[-1])
    if seen:
        yield _edges(np.array([seen[1]]), None, np.array([seen[0]]))


def _edges(hub: np.ndarray, cls: np.ndarray | None, bucket: np.ndarray, ends: tuple[int, int] | None = None) -> pa.RecordBatch:
    inner = ~np.isin(bucket, ends) if ends else None
    columns = [pa.array(hub, pa.int64()), pa.nulls(len(hub), pa.int64()) if cls is None else pa.array(cls, pa.int64()), pa.array(bucket, pa.int64(), mask=inner)]
    return pa.RecordBatch.from_arrays(columns, names=["hub", "cls", "bucket"])


def candidates(sets: DataFrame) -> DataFrame:
    """(hub, cls): in each bucket of the sets (cls, bands) the edges from its hub to every other member.

    Members are range-partitioned by bucket and class, so a bucket that holds a large part of all sets is spread over many
    tasks; each links its members to a hub of its own, which is then replaced by the least of the bucket's hubs.
    """
    members = sets.select(F.explode("bands").alias("bucket"), "cls")
    ranged = members.repartitionByRange("bucket", "cls").sortWithinPartitions("bucket", "cls")
    stars = materialise(ranged.mapInArrow(_stars, STARS), "stars")
    # Two rows a partition.
    ends = stars.where("cls IS NULL").select("bucket", "hub").distinct()
    least = ends.groupBy("bucket").agg(F.min("hub").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    inner = stars.where("cls IS NOT NULL AND bucket IS NULL").select("hub", "cls")
    outer = stars.where("cls IS NOT NULL AND bucket IS NOT NULL").join(least, "bucket", "left").select(F.coalesce("least", "hub").alias("hub"), "cls")
    hubs = ends.join(least, "bucket").select(F.col("least").alias("hub"), F.col("hub").alias("cls"))
    return inner.union(outer).union(hubs).where("hub <> cls").distinct()


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sizes na and nb of their sets and the number `both` of common runs."""
    left = sets.select(F.col("cls").alias("a"), F.col("runs").alias("_x"))
    right = sets.select(F.col("cls").alias("b"), F.col("runs").alias("_y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select(*pairs.columns, F.size("_x").alias("na"), F.size("_y").alias("nb"), F.size(F.array_intersect("_x", "_y")).alias("both"))


def _similar(similar: float, both: Column) -> Column:
    """Whether sets of the sizes na and nb with so many common runs reach the similarity."""
    return both * (1 + similar) >= (F.col("na") + F.col("nb")) * similar


def similar_classes(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b) with a < b: the pairs of similar classes of the sets (cls, runs, bands) that share a verified hub, as a table.

    Each pair is made once, for the least of the hubs that both have. The members of one verified hub have much in common
    with it, hence on average with each other, so the number of pairs made is in the order of that of similar ones.
    """
    edges = materialise(candidates(sets), "candidates")
    # From here on only classes with a candidate matter, one set of each.
    involved = bounded(edges.select(F.explode(F.array("hub", "cls")).alias("cls")).distinct(), INVOLVED_ROWS)
    unique = materialise(sets.select("cls", "runs").where("size(bands) > 0").join(involved, "cls", "left_semi").dropDuplicates(["cls"]), "classes")
    links = materialise(common(edges.toDF("a", "b"), unique).where(_similar(similar, F.col("both"))), "links")
    spokes = links.select(F.col("a").alias("hub"), F.col("na").alias("nh"), F.col("b").alias("cls"), F.col("nb").alias("n"), "both")
    own = F.col("nh")
    spokes = spokes.union(spokes.select("hub", "nh", F.col("hub").alias("cls"), own.alias("n"), own.alias("both")).distinct())
    hubs = spokes.groupBy("cls").agg(F.collect_set("hub").alias("hubs"))
    spokes = materialise(spokes.join(hubs, "cls"), "spokes")
    x = spokes.select("hub", "nh", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("both").alias("ha"), F.col("hubs").alias("_x"))
    y = spokes.select("hub", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("both").alias("hb"), F.col("hubs").alias("_y"))
    once = (F.col("a") < F.col("b")) & (F.array_min(F.array_intersect("_x", "_y")) == F.col("hub"))
    # Of what each shares with the hub, so much both share at least; no more than the less of it and of the rest at most.
    least = F.col("ha") + F.col("hb") - F.col("nh")
    most = F.least("ha", "hb") + F.least(F.col("na") - F.col("ha"), F.col("nb") - F.col("hb"))
    pairs = x.join(y, "hub").where(once & _similar(similar, most)).select("a", "b", _similar(similar, least).alias("sure"))
    pairs = materialise(pairs, "pairs")
    close = common(pairs.where("NOT sure").select("a", "b"), unique).where(_similar(similar, F.col("both")))
    found = materialise(pairs.where("sure").select("a", "b").union(close.select("a", "b")), "similar")
    discard(edges, unique, links, spokes, pairs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); root is the least node of what is connected.

    Large-star and small-star steps alternate until nothing changes, which takes a number of rounds in the order of the
    logarithm of the longest path. Edges stay in tables; only their number and checksum come to the driver.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        ways = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, cls) of every record with a main text, (a, b) of similar classes)."""
    sets = run_sets(records)
    return sets.select("id", "cls"), similar_classes(sets)


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """(rec_id_a, rec_id_b) with rec_id_a < rec_id_b: all pairs of records whose main texts have a similarity of 0.5 or more.

    * A main text is the page's main pieces joined by blanks, entities decoded, in lower case; the similarity is that of the
      sets of its runs of three words. Records without html, body or three words are in no pair.
    * Several records with the same text make every pair among them, as the result demands; class_links gives the same
      without making them. A rec_id that occurs twice is not paired with itself. An empty table gives an empty result.
    """
    members, links = near_duplicates(records)
    a = members.select(F.col("id").alias("rec_id_a"), F.col("cls").alias("a"))
    b = members.select(F.col("id").alias("rec_id_b"), F.col("cls").alias("b"))
    same = a.join(b, F.col("a") == F.col("b")).where("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b")
    other = links.join(a, "a").join(b, "b").where("rec_id_a <> rec_id_b")
    other = other.select(F.least("rec_id_a", "rec_id_b").alias("rec_id_a"), F.greatest("rec_id_a", "rec_id_b").alias("rec_id_b"))
    return same.union(other).distinct()


def groups(records: DataFrame) -> DataFrame:
    """(rec_id, group_id) of every record with a main text: what similar pairs connect; group_id is the least class in it."""
    members, links = near_duplicates(records)
    roots = components(links).select(F.col("node").alias("cls"), "root")
    return members.join(roots, "cls", "left").select(F.col("id").alias("rec_id"), F.coalesce("root", "cls").alias("group_id"))


def class_links(records: DataFrame) -> DataFrame:
    """(rec_id, class_id, n_records, n_links): each record's class, the class's size, and how many other classes are similar."""
    members, links = near_duplicates(records)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n_records"))
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    return members.join(sizes, "cls").join(ends, "cls", "left").select(F.col("id").alias("rec_id"), F.col("cls").alias("class_id"), "n_records", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
