"""Near-duplicate join on word 5-shingles by adaptive multi-match prefixes (operator 7).

A document's node is the digest of its shingle set, so exact copies are one node from the start. Shingles
have a global order: rare before frequent by a counting sketch of the whole corpus, then by hash. Two sets
of at least ``threshold`` Jaccard similarity share at least ``l`` of their first ``n - ceil(threshold * n) + l``
shingles, for every ``l``. Each document takes the ``l`` with the least estimated cost (prefix entries, and
candidates that share ``l`` of them); a pair is a candidate when its prefixes share the lesser ``l`` of both.

Candidates are never emitted as all pairs of a posting list:

1. Prefix entries that no other node has are dropped (packed blocks dealt by shingle; very frequent
   shingles are dealt by node as well, and pass).
   What a node's prefix holds alone before a shingle bounds what it can share with the others that have
   that shingle in their prefix, and parity signatures bound from below in how many shingles two sets
   differ: both settle most pairs before any set is read, and lose none.
2. Of every posting list the most typical node is paired with each other: as many pairs as entries. Each node's pair with the
   most shared entries is verified on the exact sets, and components are formed.
3. What is left are pairs of one list in different components. For each list the entries outside its most
   common component are joined with those of other components; the pairs are verified. So a list whose
   nodes are all copies of each other costs nothing more, and no link between components is missed.

The components of all links are those of the full join, for links within a component change nothing.

Hashes have 64 bits. Defined results: texts without a word have an empty set, link with nothing, and are
their own component; a null doc_id gets a null component and links with nothing; rows with equal doc_id
are one document (equal component), each with its own n_shingles; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import WordHashes, as_bytes, components, materialize, scramble, shingles, tidy

#: Counters of the sketch of shingle frequencies (bits), and of a block of it.
SKETCH, BLOCK = 20, 14
#: Prefix entries of a part on average, and estimated frequency from which a shingle is dealt by node too.
PART, HOT = 500_000, 1 << 15
MATCHES = (1, 2, 3, 4, 6, 8)
#: Places in a prefix that are told apart (13 bits); those behind count as the last one.
PLACES = (1 << 13) - 1
#: What checking a candidate costs, in prefix entries.
CHECK = 16.0
#: Members of a hub that are verified in one task.
HUB = 256
#: A node's entries before each, which tell whether two nodes have met in an earlier list.
BEFORE = ("b1", "b2")
SIGNATURE = ("s0", "s1", "s2")
#: Bits at least of the signature that a pair has to pass before its sets are read.
WIDE = 2048
ONES = np.array([i.bit_count() for i in range(256)], np.uint8)


def digest(s: np.ndarray) -> int:
    """A node's id: 63 bits over the whole set."""
    with np.errstate(over="ignore"):
        h = scramble(np.array([scramble(s).sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 % 2**64)], np.uint64))
    return int(h[0] >> np.uint64(1))


def packed_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, ascending: six bytes a shingle on their way to a comparison."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.hstack([raw, np.zeros((len(raw), 2), np.uint8)]).view(">u8").ravel().astype(np.uint64)


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """A signature: for each bit, whether it is hit an odd number of times. Two sets differ in at least as
    many shingles as their signatures in bits."""
    odd = np.bincount(((s >> np.uint64(8)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def wide_signature(s: np.ndarray) -> bytes:
    """Parities over as many bits as the set has shingles, to the next power of two: so two unrelated sets differ in
    more bits than the threshold allows, however long they are. A signature folds to any lesser width."""
    return parities(s, max(WIDE, 1 << (len(s) - 1).bit_length() if len(s) else 0)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ, at the width of the narrower."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(ONES[x ^ y].sum(dtype=np.int64))


def _blocks(counts: np.ndarray, dtype: type) -> tuple[list[int], list[bytes]]:
    parts = np.minimum(counts, np.iinfo(dtype).max).astype(dtype).reshape(-1, min(len(counts), 1 << BLOCK))
    at = [i for i, p in enumerate(parts) if p.any()]
    return at, [parts[i].tobytes() for i in at]


def summed(blocks: DataFrame, dtype: type, out: type, size: int) -> np.ndarray:
    """The sum of blocked counters, saturating at out's limit: a few MB whatever the number of rows.

    Blocks are summed as they stream by, so no task holds more than the counters themselves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                total[at] = total[at] + x if at in total else x.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()),
                pa.array([np.minimum(x, np.iinfo(out).max).astype(out).tobytes() for x in total.values()], pa.binary())
            ],
            names=["block", "data"]
        )

    each = min(size, 1 << BLOCK)
    result = np.zeros(size, out)
    for row in blocks.select("block", "data").repartition(8, "block").mapInArrow(add, "block int, data binary").collect():
        result[row["block"] * each : (row["block"] + 1) * each] = np.frombuffer(row["data"], out)
    return result


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, node, n) for each document; blocks of the sketch for each task."""
    cache = WordHashes()
    counts = np.zeros(1 << SKETCH, np.int64)
    held: list[np.ndarray] = []
    names = ["doc_id", "node", "n", "bits", "wide", "block", "data"]

    def pour() -> None:
        if held:
            np.add(counts, np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH), out=counts)
            held.clear()

    for batch in batches:
        nodes, sizes, bits, wide = [], [], [], []
        for text in as_bytes(batch.column("text")):
            s = shingles(text, cache)
            nodes.append(digest(s) if len(s) else None)
            sizes.append(len(s))
            bits.append(parities(s, 64 * len(SIGNATURE)).view(np.int64).tolist())
            wide.append(wide_signature(s))
            held.append(s)
        if sum(map(len, held)) > 1_500_000 or len(held) > 50_000:
            pour()
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
            ],
            names=names
        )
    pour()
    at, data = _blocks(counts, np.uint8)
    n = len(at)
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.binary()), pa.array(at, pa.int32()), pa.array(data, pa.binary())
        ],
        names=names
    )


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def prefix(s: np.ndarray, freq: np.ndarray, noise: float, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set, the estimated frequency of its shingles, and how many of them a partner must share."""
    est = freq[(s >> np.uint64(64 - SKETCH)).astype(np.int64)].astype(np.float64)
    est = np.where(est > noise, est - noise / 2, 0.0)
    level = np.where(est > 0, np.log2(est + 1).astype(np.int64), 0)
    order = np.lexsort((s, level))
    est = est[order]
    total = np.cumsum(est)
    base = len(s) - least_overlap(len(s), num, den)
    best, cost = 1, np.inf
    for m in MATCHES:
        if base + m > len(s):
            break
        x = base + m + (1 + CHECK / m) * total[base + m - 1]
        if x < cost:
            best, cost = m, x
    keep = order[: base + best]
    return s[keep], est[: base + best], best


def _entries(docs: DataFrame, freq: np.ndarray, parts: int, num: int, den: int, hot: float) -> DataFrame:
    """(part, hot, rows, data): packed prefix entries: a shingle's 32 (hot: 64) bits, the node, and a code of
    the shingle's place in the prefix and the matches needed."""
    noise = 3.0 * float(freq.mean()) + 2.0
    shared = docs.sparkSession.sparkContext.broadcast(freq)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        rows = 0

        def pack() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([h[0] for h in held])
            est = np.concatenate([h[1] for h in held])
            each = [len(h[0]) for h in held]
            nodes = np.repeat(np.array([h[2] for h in held], np.int64), each)
            place = np.concatenate([np.minimum(np.arange(k), PLACES) for k in each])
            code = (place << 3 | np.repeat([MATCHES.index(h[3]) for h in held], each)).astype(np.uint16)
            first = (tokens >> np.uint64(32)) % np.uint64(parts)
            is_hot = est >= hot
            part = np.where(is_hot, (first + nodes.view(np.uint64)) % np.uint64(parts), first).astype(np.int64)
            key = part * 2 + is_hot
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            out = []
            for at in np.split(order, cuts):
                token = (first[at] << np.uint64(32)) | (tokens[at] & np.uint64(0xFFFFFFFF)) if is_hot[at[0]] else tokens[at].astype(np.uint32)
                out.append((int(part[at[0]]), bool(is_hot[at[0]]), len(at), token.tobytes() + nodes[at].tobytes() + code[at].tobytes()))
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.bool_()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
                names=["part", "hot", "rows", "data"]
            )

        for batch in batches:
            for text in as_bytes(batch.column("text")):
                s = shingles(text, cache)
                if not len(s):
                    continue
                node = digest(s)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                tokens, est, need = prefix(s, shared.value, noise, num, den)
                held.append((tokens, est, node, need))
                rows += len(tokens)
                if rows > 500_000:
                    yield from pack()
                    held.clear()
                    rows = 0
        if held:
            yield from pack()

    return docs.select("text").mapInArrow(tidy(emit), "part long, hot boolean, rows long, data binary")


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, code) of the shingles that more than one node has; hot ones all."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    names = ["token", "node", "code"]
    for batch in batches:
        for part, hot, rows, data in zip(*(batch.column(c).to_pylist() for c in ("part", "hot", "rows", "data")), strict=True):
            width = 8 if hot else 4
            token = np.frombuffer(data, np.uint64 if hot else np.uint32, rows)
            node = np.frombuffer(data, np.int64, rows, width * rows) if width * rows % 8 == 0 else np.frombuffer(data[width * rows : width * rows + 8 * rows], np.int64)
            code = np.frombuffer(data, np.uint16, rows, (width + 8) * rows)
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(code.astype(np.int32))], names=names)
            else:
                held.setdefault(part, []).append((token, node, code))
    for part, blocks in held.items():
        token, node, code = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.lexsort((node, token))
        token, node, code = token[order], node[order], code[order]
        fresh = np.ones(len(token), bool)  # the same node from several tasks
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, code = token[fresh], node[fresh], code[fresh]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        same[:-1] |= same[1:]
        if same.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 32) | token[same].astype(np.int64)), pa.array(node[same]), pa.array(code[same].astype(np.int32))],
                names=names
            )


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, data): the exact sets of the nodes asked for, each from one document.

    nodes: (node, doc_id). A bit set of the doc_ids (bounded: 2 MB) goes to all tasks, so that only the
    texts asked for, and few others, are shingled and moved; a join settles which."""
    size = 1 << 24

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_spot(batch.column("doc_id"))] = True
        at, data = _blocks(np.packbits(bits).astype(np.int64), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    def _spot(ids: pa.Array) -> np.ndarray:
        return (scramble(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total[at] = total.get(at, np.uint8(0)) | np.frombuffer(data, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"]
        )

    packed = np.zeros(size // 8, np.uint8)
    for row in nodes.select("doc_id").mapInArrow(mark, "block int, data binary").repartition(8, "block").mapInArrow(union, "block int, data binary").collect():
        packed[row["block"] << BLOCK : (row["block"] + 1) << BLOCK] = np.frombuffer(row["data"], np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(packed)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids = batch.column("doc_id")
            at = _spot(ids)
            hit = np.flatnonzero(bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if not len(hit):
                continue
            chosen = batch.take(pa.array(hit))
            sets = [shingles(t, cache) for t in as_bytes(chosen.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.int64()), pa.array([packed_set(s) for s in sets], pa.binary())],
                names=["node", "data"]
            )

    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(build), "node long, data binary")
    # one shuffle by node serves the join, the choice of one text, and the join with pairs that follows
    return found.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("data").alias("data"))


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose exact sets reach the threshold.

    Sets meet at hubs (a); a hub's members are salted, so each task sees a hub's set and at most about
    HUB members, as they stream by. firsts: (node, doc_id)."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(docs, firsts.join(asked, "node", "left_semi"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("k")).withColumn("salts", F.ceil(F.col("k") / HUB).cast("int"))
    members = pairs.join(degree.select("a", "salts"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).select("a", "salt", F.col("b").alias("node"))
    hubs = degree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("a", "salt", F.col("a").alias("node"))
    rows = members.unionByName(hubs).join(sets, "node").select("a", "salt", (F.col("node") != F.col("a")).alias("member"), "node", "data")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.array([], np.uint64)
        for batch in batches:
            out = []
            for a, member, node, data in zip(*(batch.column(c).to_pylist() for c in ("a", "member", "node", "data")), strict=True):
                s = unpacked_set(data)
                if not member:
                    hub, own = a, s
                    continue
                assert a == hub, "a hub's own set comes first"
                small, large = (s, own) if len(s) <= len(own) else (own, s)
                if den * len(small) < num * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if den * both >= num * (len(s) + len(own) - both):
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"]
                )

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(tidy(check), "a long, b long")


def _capped(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries with their node's size and signature, what bounds what it shares, and the node's two entries before.

    Prefixes are the first shingles of one global order. So of two nodes that both have an entry, the shingles
    that they share before it stand in both prefixes: at most as many as either has there that any other node
    has, too (held). From the entry on, neither can share more than it has left (rest). One shuffle by node gives all of it."""
    order = Window.partitionBy("node").orderBy("place", "token")
    coded = entries.select(
        "token", "node", F.shiftright("code", 3).alias("place"),
        F.element_at(F.array(*map(F.lit, MATCHES)), F.col("code").bitwiseAND(7) + 1).alias("need")
    )
    rows = coded.withColumns(
        {"held": (F.row_number().over(order) - 1).cast("long"), "b1": F.lag("token", 1).over(order), "b2": F.lag("token", 2).over(order)}
    ).join(nodes.select("node", "n", *SIGNATURE), "node")
    return rows.select("token", "node", "need", "n", "held", (F.col("n") - F.col("place")).alias("rest"), *SIGNATURE, *BEFORE)


def _viable(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries whose list holds another size with which their own bound lets their node link.

    A list's sizes are kept as a set of steps of two hundredths, so a list needs a bounded number of them
    however long it is."""
    step = lambda x: F.floor(F.log(x) * 50).cast("int")
    cap = F.least(F.col("held") + F.col("rest"), F.col("n"))
    least, most = F.col("n") * num / den, F.least(F.col("n") * den / num, cap * (num + den) / num - F.col("n"))
    # a list of one node has one size but no partner
    lists = entries.groupBy("token").agg(
        F.collect_set(step(F.col("n").cast("double"))).alias("steps"), F.min("node").alias("first"), F.max("node").alias("last")
    ).where("first <> last").select("token", "steps")
    low, high = step(F.greatest(least - 0.5, F.lit(0.1))), step(most + 0.5)
    return entries.where(most >= least - 1e-6).join(lists, "token").where(F.exists("steps", lambda s: (s >= low) & (s <= high))).drop("steps")


def _near_by_signature(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, need) whose wide signatures allow the threshold."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 500):
                batch = whole.slice(first, 500)
                apart = np.array(
                    [bits_apart(x, y) for x, y in zip(batch.column("wide_a").to_pylist(), batch.column("wide_b").to_pylist(), strict=True)],
                    np.int64
                )
                sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                yield batch.select(["a", "b", "need"]).take(pa.array(np.flatnonzero((num + den) * apart <= (den - num) * sizes)))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(near), "a long, b long, need int")


def linked(docs: DataFrame, num: int = 80, den: int = 100, hot: float = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; a link is num / den Jaccard similarity at least."""
    docs = docs.select("doc_id", "text")
    survey = materialize(docs.mapInArrow(tidy(_survey), "doc_id long, node long, n long, bits array<long>, wide binary, block int, data binary"), "survey")
    rows = survey.where("n is not null").select("doc_id", "node", "n", "bits", "wide")
    freq = summed(survey.where("block is not null"), np.uint8, np.uint32, 1 << SKETCH)
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-total * (den - num) // den // PART))
    nodes = materialize(
        rows.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
            *(F.first(F.col("bits")[i]).alias(f"s{i}") for i in range(len(SIGNATURE))), F.first("wide").alias("wide")
        ),
        "nodes"
    )
    entries = _entries(docs.where("doc_id is not null"), freq, parts, num, den, hot)
    # all of a shingle's entries, but hot ones, meet in the task of its part; a hot one may come twice, which
    # only makes the bounds below looser
    shared = entries.repartition(parts, "part").mapInArrow(tidy(_shared_entries), "token long, node long, code int")
    placed = materialize(_viable(_capped(shared, nodes), num, den), "entries")
    node = [F.col(c) for c in ("node", "need", "n", "held", "rest", *SIGNATURE)]

    def may_link(a: str, b: str) -> Column:
        """Sizes, places and signatures that allow the threshold."""
        apart = " + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in SIGNATURE)
        return F.expr(
            f"{num + den} * ({apart}) <= {den - num} * ({a}.n + {b}.n) and {den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and {num + den} * (least({a}.held, {b}.held) + least({a}.rest, {b}.rest)) >= {num} * ({a}.n + {b}.n)"
        )

    # each list's most typical node (the one with the least of its own) with every other
    typical = placed.groupBy("token").agg(
        F.max(F.struct(((F.col("held") + F.col("rest")) / F.col("n")).alias("typical"), *node)).alias("x"), F.min("node").alias("first"),
        F.max("node").alias("last")
    ).where("first <> last").select("token", "x")
    star = placed.select("token", F.struct(*node).alias("y")).join(typical, "token").where("x.node <> y.node").where(may_link("x", "y"))
    star = star.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.count("*").alias("k"), F.min(F.least("x.need", "y.need")).alias("need")
    ).where("k >= need")
    tried = star.groupBy("b").agg(F.max_by(F.struct("a", "need"), F.struct("k", "a")).alias("x")).select("x.a", "b", "x.need")
    tried = materialize(tried, "star")
    near = materialize(_near_by_signature(tried, nodes, num, den).select("a", "b"), "star-near")
    links = materialize(verified(docs, near, nodes.select("node", "doc_id"), num, den), "links-star")

    # entries of lists that still hold several components
    so_far = components(links)
    now = placed.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = materialize(now, "placed")
    per = now.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = per.groupBy("token").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("of")
    ).where("of > 1").select("token", "main")
    mixed = now.join(main, "token").select("token", "main", F.struct(*node, *BEFORE, "component").alias("y"))
    outside = mixed.where("y.component <> main").select("token", F.col("y").alias("x"))
    # where two nodes share an entry just before this one, they have met already (if they may link, both of
    # them stand in that list, too)
    met = F.lit(False)
    for i in BEFORE:
        for j in BEFORE:
            met = met | F.coalesce(F.col(f"x.{i}") == F.col(f"y.{j}"), F.lit(False))
    # a pair outside the main component comes once, by its lesser node first
    crossed = outside.join(mixed, "token").where(
        "x.component <> y.component and (y.component = main or x.node < y.node)"
    ).where(~met & may_link("x", "y"))
    pairs = crossed.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.need", "y.need").alias("need")
    ).distinct()
    pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    pairs = materialize(_near_by_signature(pairs, nodes, num, den), "pairs")
    # how many entries they share; a node's entries are a part of one document's shingles
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    lists = placed.select("node", "token").join(asked, "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens"))
    both = pairs.join(
        lists.select(F.col("node").alias("a"), F.col("tokens").alias("s")), "a"
    ).join(lists.select(F.col("node").alias("b"), F.col("tokens").alias("t")), "b")
    more = materialize(both.where(F.size(F.array_intersect("s", "t")) >= F.col("need")).select("a", "b"), "cross")
    found = links.unionByName(materialize(verified(docs, more, nodes.select("node", "doc_id"), num, den), "links-cross"))

    # documents of equal doc_id are one: their nodes are linked, too
    twice = rows.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    again = rows.join(twice, "doc_id").select("a", F.col("node").alias("b"))
    final = components(found.unionByName(again))
    labels = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = labels.select("node", "component").join(smallest, "component").select("node", "component_id")
    out = rows.join(label, "node", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id")
    )



