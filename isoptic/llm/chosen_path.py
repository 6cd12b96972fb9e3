"""Near-duplicate documents by a chosen-path join of their sets of word n-grams.

Equal sets are one class. Each class has minwise tokens: for each of ``FUNCTIONS`` random
orders of all n-grams, the first one in its set. A tree branches at its root by the token
of one order, and each node by those of one order or two, as many nodes so as so, that the node
itself chooses. A pair at the threshold meets in 1.2 children of each node that it is in,
so that over half of all trees keep it at any depth, and pairs under two thirds meet in
ever fewer. Trees are repeated until the share of links that none of them finds is below
what is aimed at, one in 100,000 (``missed``).

A node is searched once it is small enough: not by its sets, but by its pairs of sets
that are not connected yet. Before any branching, in a few rounds, each set is held
against one other of its nodes, and links make components; nodes within one component
are done. What a node has left is compared exhaustively in blocks of bounded size, in as
many tasks as there are pairs of blocks: by sketches, which drop a pair of linked sets
with a probability of about 1e-7, and then, for pairs that pass, on full sets. Nodes
that have branched ``DEPTH`` times are searched whatever they hold. Only their blocks
meet in a task, never a node, a component or a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .jaccard import _compared, _name, _ranges, _sets
from .skew import hinted, salted_join, tasks
from .store import discard, keep, small_batches

#: The threshold is NUM / DEN.
NUM, DEN, WORDS = 4, 5, 4
#: Orders of the n-grams, and trees: each of these has a root of its own.
FUNCTIONS, TREES = 32, 20
#: Bins of a sketch, each with half a byte of its least n-gram, and by how many deviations
#: fewer bins than expected have to agree for a pair to be dropped.
BINS, SIGMA = 1024, 5.5
#: Times that a node branches at most, and open pairs per set up to which it doesn't,
#: nor any node when all that is left has as many per set of the whole.
DEPTH, WIDE = 10, 512
#: Sets of a block.
BLOCK = 1024
#: Parts that a node's rows are dealt to; Spark splits what is still large.
SALTS = 4
#: Rounds in which sets are held against one other each.
ROUNDS = 3
#: Rows that a task takes between shuffles, and tasks at least: what is left of few sets
#: isn't dealt to as many tasks as the session shuffles to.
ROWS, LEAST = 20_000, 24
#: Of all trees, those whose roots linked sets have in common at least: fewer with a
#: probability of 2e-7 at the threshold, and less beyond.
MET = 6
SIGNED = "id long, s long, n long, mins binary, sketch binary"


def missed(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that no tree has a pair of this similarity in one node at
    ``depth`` (0: what roots branch to)."""
    found = 1.0
    for _ in range(depth):
        one, two = 1 - similarity * found, (1 - similarity * found) ** 2
        found = 1 - (one + two) / 2
    return (1 - similarity * found) ** trees


def _constants(n: int, first: int) -> np.ndarray:
    return tokens.multipliers(first + n)[first:]


def minwise(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of ``values``, the least in each order: (run, function)."""
    out = np.empty((len(starts), FUNCTIONS), np.uint64)
    turn, odd = _constants(FUNCTIONS, 100), _constants(FUNCTIONS, 200)
    for k in range(FUNCTIONS):
        out[:, k] = np.minimum.reduceat((values ^ turn[k]) * odd[k], starts)
    return out


def sketches(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Of each row's ascending hashes, a number from 1 to 15 of the least in each bin; 0
    where a bin has none."""
    bin_ = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (rows[1:] != rows[:-1])
    out = np.zeros((count, BINS), np.uint8)
    out[rows[first], bin_[first]] = 1 + (values[first] & np.uint64(0xFFFFFF)) % np.uint64(15)
    return out


def packed(sketch: np.ndarray) -> np.ndarray:
    """Sketches with sixteen bins in a word."""
    return np.ascontiguousarray(sketch[:, ::2] | sketch[:, 1::2] << 4).view("<u8")


def _filled(words: np.ndarray) -> np.ndarray:
    """A bit for each bin that isn't 0."""
    half = words | words >> np.uint64(2)
    return (half | half >> np.uint64(1)) & np.uint64(0x1111111111111111)


def _signed(words: int):
    """Each document's set by name and size; a set's tokens and sketch once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in tokens.pieces(batches, "text"):
            sets = _sets(batch.column("text"), words)
            names = [_name(x) if len(x) else None for x in sets]
            new = []
            for row, s in enumerate(names):
                if s is not None and s not in done:
                    done.add(s)
                    new.append(row)
            mins, sketch = [None] * len(sets), [None] * len(sets)
            if new:
                size = np.array([len(sets[r]) for r in new])
                values = np.concatenate([sets[r] for r in new])
                least = minwise(values, np.append(0, np.cumsum(size)[:-1]))
                drawn = packed(sketches(values, np.repeat(np.arange(len(new)), size), len(new)))
                for k, r in enumerate(new):
                    mins[r], sketch[r] = least[k].tobytes(), drawn[k].tobytes()
            columns = [batch.column("id"), pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(mins, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.record_batch(columns, names=["id", "s", "n", "mins", "sketch"])

    return tokens.tidy(run)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    data, _ = tokens.buffers(column)
    return data.view(dtype).reshape(len(column), width)


def _entries(key: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 100_000):
        yield pa.record_batch([pa.array(key[at : at + 100_000].view(np.int64)), pa.array(s[at : at + 100_000])], names=["key", "s"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's node below every root."""
    odd = _constants(TREES, 300)
    for batch in batches:
        if batch.num_rows:
            key = tokens.mix64(_matrix(batch.column("mins"), "<u8", FUNCTIONS)[:, :TREES] + odd)
            yield from _entries(key.ravel(), np.repeat(batch.column("s").to_numpy(), TREES))


def chosen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that each node branches by, a second one, and whether it does by that."""
    r = tokens.mix64(key + _constants(1, 400)[0])
    one = (r >> np.uint64(8)) % np.uint64(FUNCTIONS)
    two = (one + np.uint64(1) + (r >> np.uint64(24)) % np.uint64(FUNCTIONS - 1)) % np.uint64(FUNCTIONS)
    return one.astype(np.int64), two.astype(np.int64), r % np.uint64(2) == 0


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's nodes below the nodes that it is in."""
    odd = _constants(FUNCTIONS, 500)
    for batch in batches:
        if batch.num_rows:
            key, s, mins = batch.column("key").to_numpy().astype(np.uint64), batch.column("s").to_numpy(), _matrix(batch.column("mins"), "<u8", FUNCTIONS)
            one, two, both = chosen(key)
            for order, some in ((one, np.ones(len(key), bool)), (two, both)):
                k = order[some]
                child = tokens.mix64(tokens.mix64(key[some] * odd[k] + np.uint64(1)) + mins[np.flatnonzero(some), k])
                yield from _entries(child, s[some])


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bins of two (packed) sketches agree, and whether they may be of linked
    sets of these sizes.

    The bins' least n-grams are a random part of the union, drawn without returning any,
    so those that both sets have are distributed hypergeometrically. A linked pair's union
    has a largest size; the more of it the bins hold, the less chance is left.
    """
    count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    drawn = count(_filled(x) | _filled(y))
    same = drawn - count(_filled(x ^ y))
    p, union = NUM / DEN, (n + m) * DEN / (NUM + DEN)
    spread = drawn * p * (1 - p) * np.maximum(union - drawn, 0) / np.maximum(union - 1, 1)
    return same, (same >= drawn * p - SIGMA * np.sqrt(spread) - 1e-9) & (drawn <= union + 1e-9)


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<i8"), ("root_a", "<i8"), ("root_b", "<i8")])
#: Pairs that a task holds before it sends them on, and buckets that sum them up, at least.
HELD, BUCKETS = 200_000, 64


def _once(found: np.ndarray) -> np.ndarray:
    """Each pair once."""
    found = found[np.lexsort((found["b"], found["a"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
    return found[new]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a unit's sets that may be links between components, packed by the bucket
    that finds those of several nodes. Rows come by unit, which has at most two blocks;
    ``side`` tells them apart, 2 being a block by itself."""
    held: pa.Table | None = None
    found, size = [], 0

    def send() -> Iterator[pa.RecordBatch]:
        e = _once(np.concatenate(found))
        m = tokens.multipliers(2)
        b = (tokens.mix64(e["a"].astype(np.uint64) * m[0] + e["b"].astype(np.uint64) * m[1]) % np.uint64(BUCKETS)).astype(np.int64)
        e, b = e[np.argsort(b, kind="stable")], np.sort(b)
        cut = np.searchsorted(b, np.arange(BUCKETS + 1)).tolist()
        rows = [(k, e[x:y].tobytes()) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        if rows:
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])
        found.clear()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        unit = held.column("unit").to_numpy()
        whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
        if whole >= 4096:
            found.append(_pairs_of(held.slice(0, whole).combine_chunks()))
            size += len(found[-1])
            held = held.slice(whole).combine_chunks()
            if size > HELD:
                yield from send()
                size = 0
    if held is not None and held.num_rows:
        found.append(_pairs_of(held.combine_chunks()))
    if found:
        yield from send()


def _pairs_of(t: pa.Table) -> np.ndarray:
    unit, s, root, n, side = (t.column(c).to_numpy() for c in ("unit", "s", "root", "n", "side"))
    sketch = _matrix(t.column("sketch").combine_chunks(), "<u8", BINS // 16)
    begin = np.searchsorted(unit, unit)
    seen = [np.zeros(0, PAIR)]
    for i, j in _ranges(begin, np.arange(len(unit)), np.arange(len(unit))):
        ok = (root[i] != root[j]) & ((side[i] == 2) | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * DEN >= np.maximum(n[i], n[j]) * NUM)
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            same, good = alike(sketch[x], sketch[y], n[x], n[y])
            e = np.empty(int(good.sum()), PAIR)
            x, y, e["c"] = x[good], y[good], same[good]
            turn = s[x] > s[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            e["a"], e["b"], e["root_a"], e["root_b"] = s[x], s[y], root[x], root[y]
            seen.append(e)
    return _once(np.concatenate(seen))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs, each once."""
    parts = [np.frombuffer(x, PAIR) for batch in batches for x in batch.column("blob").to_pylist()]
    if parts:
        e = _once(np.concatenate(parts))
        for at in range(0, len(e), 100_000):
            yield pa.record_batch([pa.array(e[k][at : at + 100_000].copy()) for k in PAIR.names], names=list(PAIR.names))


def _owned(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries with the component of their set, itself at first."""
    if roots is None:
        return entries.withColumn("root", F.col("s"))
    return entries.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs of different components, with these."""
    for c in ("a", "b"):
        pairs = pairs.withColumn(f"root_{c}", F.col(c)) if roots is None else pairs.join(roots.withColumnsRenamed({"node": c, "root": f"root_{c}"}), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.where("root_a <> root_b")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than ``rows`` are worth."""
    return df.coalesce(tasks(rows, ROWS, LEAST))


def _held_against(shared: DataFrame, roots: DataFrame | None, number: int, rows: int) -> DataFrame:
    """Each set with one of another component, ``a`` and ``b``: of the first and last
    sets of its nodes, in an order of this round, the one that it meets most often."""
    turn = F.lit(int(_constants(number + 1, 600)[number].view(np.int64)))
    owned = _owned(shared, roots)
    ends = owned.groupBy("key").agg(F.min(F.col("s").bitwiseXOR(turn)).alias("lo"), F.max(F.col("s").bitwiseXOR(turn)).alias("hi"), F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").drop("u", "v")
    met = _few(salted_join(owned, _few(ends, rows), ["key"], ["s"], how="inner", salts=SALTS), rows)
    both = met.select(F.col("s").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).select("a", F.col("b").bitwiseXOR(turn).alias("b")).where("a <> b")
    often = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= MET)
    best = _few(_apart(_few(often, rows), roots).groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")), rows)
    return _few(best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct(), rows)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, name: str) -> DataFrame:
    """The pairs that are links, on full sets."""
    return _compared(pairs, docs, classes, words, name, rows=pairs.count()).where(F.col("o") * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM).select("a", "b")


def _units(mixed: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """What of each node meets in a task: ``unit``, ``side``, ``s``, ``root``. A large
    component has blocks of its own, which aren't held against each other."""
    few = nodes.where(F.col("n") <= BLOCK).select("key")
    small = mixed.join(few, "key", "left_semi").select(F.col("key").alias("unit"), F.lit(2).alias("side"), "s", "root")
    large = nodes.where(F.col("n") > BLOCK)
    count = F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    rest = large.select("key", F.lit(None).cast("long").alias("owner"), (F.col("n") - F.col("own")).alias("m")).where("m > 0")
    own = comps.where(F.col("m") > BLOCK).join(large.select("key"), "key").select("key", F.col("root").alias("owner"), "m")
    parts = own.unionByName(rest).withColumn("of", count)
    label = lambda owner, i: F.xxhash64(F.coalesce(owner, F.lit(0)), owner.isNull(), i)
    labels = parts.select("key", "owner", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i")).select("key", "owner", label(F.col("owner"), F.col("i")).alias("label"))
    other = labels.withColumnsRenamed({"owner": "owner2", "label": "label2"})
    both = labels.join(other, "key").where("label <= label2 and not (owner <=> owner2 and owner is not null)")
    unit = both.select("key", F.xxhash64("key", "label", "label2").alias("unit"), "label", "label2")
    side = F.when(F.col("label") == F.col("label2"), F.array(F.struct("label", F.lit(2).alias("side")))).otherwise(F.array(F.struct("label", F.lit(0).alias("side")), F.struct(F.col("label2").alias("label"), F.lit(1).alias("side"))))
    sides = unit.select("key", "unit", F.explode(side).alias("x")).select("key", "unit", "x.label", "x.side")
    # A set is in the blocks of its component if that is large, else in one of the rest.
    named = own.withColumnRenamed("m", "m_own")
    placed = salted_join(mixed, large.select("key", (F.col("n") - F.col("own")).alias("left")), ["key"], ["s"], how="inner", salts=SALTS)
    placed = salted_join(placed.withColumnRenamed("root", "owner"), named, ["key", "owner"], ["s"], how="left", salts=SALTS)
    of = F.greatest(F.ceil(F.coalesce("m_own", "left") / BLOCK), F.lit(1)).cast("int")
    owner = F.when(F.col("m_own").isNotNull(), F.col("owner"))
    blocked = placed.select("key", "s", F.col("owner").alias("root"), label(owner, F.pmod(F.xxhash64("s"), of).cast("int")).alias("label"))
    return small.unionByName(blocked.join(sides, ["key", "label"]).select("unit", "side", "s", "root"))


def _often(entries: DataFrame) -> DataFrame:
    """Entries of sets that have as many as linked sets have in common."""
    sets = entries.groupBy("s").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MET).select("s")
    return entries.join(sets, "s", "left_semi")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of nodes with several sets."""
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    return salted_join(entries, several, ["key"], ["s"], how="inner", salts=SALTS).select("key", "s")


def _candidates(shared: DataFrame, signed: DataFrame, roots: DataFrame | None, depth: int = DEPTH) -> DataFrame:
    """Pairs of sets of different components (``a``, ``b``, ``c``: bins that agree,
    ``root_a``, ``root_b``) that meet in a node and whose sketches allow a link, each once."""
    out, entries, most = [], shared, WIDE * signed.count()
    for level in range(depth + 1):
        held = entries.count()
        owned = _owned(entries, roots)
        several = owned.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("key")
        mixed = _few(salted_join(owned, _few(several, held), ["key"], ["s"], how="inner", salts=SALTS).select("key", "s", "root"), held)
        mixed = keep(mixed if level else _few(_often(mixed), held), f"mixed-{level}")
        if level:
            discard(entries)
        comps = keep(_few(mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")), held), f"parts-{level}")
        sums = comps.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("sq"), F.sum(F.when(F.col("m") > BLOCK, F.col("m")).otherwise(0)).alias("own"))
        left = (F.col("n").cast("double") * F.col("n") - F.col("sq")) / 2
        nodes = keep(_few(sums, held).withColumn("open", left).withColumn("small", (F.col("n") <= BLOCK) | (left <= float(WIDE) * F.col("n"))), f"nodes-{level}")
        going = nodes.where("not small").agg(F.sum("open")).first()[0]
        if level == depth or going is not None and going <= most:
            nodes, going = nodes.withColumn("small", F.lit(True)), None
        units = _few(_units(mixed, nodes.where("small"), comps), held)
        rows = keep(_few(units.join(signed.select("s", F.col("n"), "sketch"), "s"), 8 * held), f"units-{level}")
        dealt = rows.repartition(tasks(rows.count(), 20_000), "unit").sortWithinPartitions("unit")
        out.append(keep(dealt.mapInArrow(tokens.tidy(_searched), "bucket long, blob binary"), f"found-{level}"))
        discard(rows)
        if going is None:
            break
        large = nodes.where("not small").select("key")
        going = _few(salted_join(mixed, large, ["key"], ["s"], how="inner", salts=SALTS).select("key", "s"), held)
        entries = keep(_few(going.join(signed.select("s", "mins"), "s"), held).select("key", "s", "mins").mapInArrow(tokens.tidy(_branched), "key long, s long"), f"entries-{level}")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.repartition(BUCKETS, "bucket").select("blob").mapInArrow(tokens.tidy(_unpacked), "a long, b long, c long, root_a long, root_b long")


def _joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``links`` beside what is connected."""
    return hinted(keep(components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each of ``docs``: ``id``, ``n_shingles``, ``class_id`` (the smallest id
    with the same set), ``component_id`` (the smallest id that links reach, 80 % of
    Jaccard similarity or more) and ``kept``, whether the row has that id.

    A-Z are lower-cased; a text with fewer than ``words`` words is one shingle; one
    without words or a null is empty, a class of its own and linked with nothing. Rows
    that repeat an id are taken one by one, and kept alike. A null id belongs to its class,
    but names it only if it has no other; it is kept where its component has no id.
    n-grams and sets are compared by 64-bit hashes. Other columns are ignored; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = keep(rows.mapInArrow(_signed(words), SIGNED), "signed")
    members = scan.select("id", "s", "n")
    classes = keep(members.where("s is not null").groupBy("s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    signed = keep(scan.where("mins is not null").select("s", "n", "mins", "sketch").dropDuplicates(["s"]), "tokens")

    entries = keep(signed.select("s", "mins").mapInArrow(tokens.tidy(_rooted), "key long, s long"), "entries")
    # Sets that meet others in few trees have no link, and nodes shrink without them.
    held = entries.count()
    some = keep(_few(_often(_few(_shared(entries), held)), held), "some")
    left = some.count()
    shared = keep(_few(_often(_few(_shared(some), left)), left), "shared")
    left = shared.count()
    discard(entries)
    discard(some)
    roots = None
    for number in range(ROUNDS):
        asked = keep(_held_against(shared, roots, number, left), "held-against")
        if asked.isEmpty():
            break
        links = _linked(asked, rows, classes, words, f"round-{number}")
        if links.isEmpty():
            break
        roots = _joined(links, roots)
    left = keep(_few(_candidates(shared, signed, roots), left), "candidates")
    # Of two components the likeliest pair first: mostly that connects them.
    both = F.least("root_a", "root_b").alias("u"), F.greatest("root_a", "root_b").alias("v")
    best = keep(left.groupBy(*both).agg(F.max(F.struct("c", "a", "b")).alias("x")).select("u", "v", "x.a", "x.b"), "best")
    if best.isEmpty():
        return _classed(members, classes, roots)
    links = _linked(best.select("a", "b"), rows, classes, words, "best")
    if not links.isEmpty():
        roots = _joined(links, roots)
    # Then all pairs of components that this has left apart.
    apart = _apart(best.select(F.col("u").alias("a"), F.col("v").alias("b")), roots).select(F.col("a").alias("u"), F.col("b").alias("v"))
    rest = keep(left.select("a", "b", *both).join(apart, ["u", "v"], "left_semi").join(best, ["a", "b"], "left_anti").select("a", "b"), "rest")
    if not rest.isEmpty():
        links = _linked(rest, rows, classes, words, "rest")
        if not links.isEmpty():
            roots = _joined(links, roots)
    return _classed(members, classes, roots)


def _classed(members: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Only classes of several documents or with links need a join."""
    linked = classes.withColumn("root", F.lit(None).cast("long")) if roots is None else classes.join(roots.withColumnRenamed("node", "s"), "s", "left")
    named = linked.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "s"))
    whole = named.groupBy("root").agg(F.min("first").alias("component_id"))
    per_class = salted_join(named, whole, ["root"], ["s"], how="inner", salts=4).select("s", F.col("first").alias("class_id"), "component_id", F.lit(True).alias("_found"))
    out = salted_join(members.withColumn("_row", F.monotonically_increasing_id()), per_class, ["s"], ["_row"])
    found = lambda c: F.when(F.col("_found"), F.col(c)).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), found("class_id").alias("class_id"), found("component_id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
