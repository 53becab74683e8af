"""The trie of rebuilt conversations, from products of turn hashes.

A rebuilt conversation is a head of another one's turns and then its own turns after as many. Its texts are
never put together. A turn's hash is a polynomial of degree 0; the product of two sequences of turns is
(H1 * B^n2 + H2, n1 + n2) modulo 2^127 - 1, a monoid, so the fingerprint of any rebuilt prefix is the product of the base's
head (at most five turns) and a part of the own prefix products: P(own, k) + (P(base, h) - P(own, h)) * B^(k - h).
Prefix products are worked out in segments (``turns``) and folded over a conversation's few segments, so a conversation
may be of any length.

A node is a depth and a fingerprint. Each step keeps a reference to the stored turn it stands on; the turns that a
node's members refer to are read back and compared, and the same for the prefixes, so equal fingerprints of
unequal prefixes are found, and all is built anew over another base B.

Nodes of one smallest member are a chain that runs to its end, so the trie is a tree of chains, no more than
there are conversations. Sums over subtrees are doubled up along the chains' parents (rounds: the logarithm of their depth),
then run backwards along each chain, block by block.

Defined results: rows without a conv_id are left out; rows of one turn go by role, then text (``turns``); a null turn comes first;
a null role or text is empty; equal rows are turns each; without rows there is no root. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.llm.storage import bounded_batches, written
from launchgrid.llm.turns import in_order, segments, text_hash

PRIME = 2**127 - 1
HEAD = 5  # the longest head
ROOT = bytes(16)
BLOCK_BITS, IDS_BITS = 10, 12


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(b"turn base %d" % seed).digest(), "big") % PRIME


def _int(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _elements(items: pa.Array) -> list[int]:
    """Turn hashes from two 64-bit halves."""
    high, low = (items.field(c).to_numpy(zero_copy_only=False).astype("u8").tolist() for c in ("h1", "h2"))
    return [((a << 64) + b) % (PRIME - 1) + 1 for a, b in zip(high, low, strict=True)]


def _offsets(column: pa.Array) -> list[int]:
    out = [0]
    for n in column.value_lengths().to_pylist():
        out.append(out[-1] + n)
    return out


STEP = "struct<fp: binary, at: long, size: long>"
PARTS = f"conv_id long, sid long, n long, product binary, heads array<{STEP}>"
_STEPS = pa.list_(pa.struct([("fp", pa.binary()), ("at", pa.int64()), ("size", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("product", pa.binary()), ("heads", _STEPS)])


def _products(seed: int):
    base = base_of(seed)

    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each segment: its length, its product, and its first turns."""
        for batch in batches:
            rows = batch.column("rows")
            items, offsets, out = rows.flatten(), _offsets(rows), []
            elements, ats, sizes = _elements(items), items.field("at").to_pylist(), items.field("size").to_pylist()
            for conv, sid, i, j in zip(batch.column("conv_id").to_pylist(), batch.column("sid").to_pylist(), offsets, offsets[1:], strict=False):
                h, heads = 0, []
                for k in range(i, j):
                    h = (h * base + elements[k]) % PRIME
                    if k < i + HEAD:
                        heads.append({"fp": _bytes(h), "at": ats[k], "size": sizes[k]})
                out.append({"conv_id": conv, "sid": sid, "n": j - i, "product": _bytes(h), "heads": heads})
            yield pa.RecordBatch.from_pylist(out, _PARTS)

    return job


CONVS = f"conv_id long, n long, heads array<{STEP}>, segs array<struct<sid: long, start: long, prefix: binary>>"
_SEGS = pa.list_(pa.struct([("sid", pa.int64()), ("start", pa.int64()), ("prefix", pa.binary())]))
_CONVS = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("heads", _STEPS), ("segs", _SEGS)])


def _conversations(seed: int):
    base = base_of(seed)

    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of a conversation's segments, in order."""
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                n, h, heads, segs = 0, 0, [], []
                for p in parts:
                    segs.append({"sid": p["sid"], "start": n, "prefix": _bytes(h)})
                    for k, step in enumerate(p["heads"][: max(0, HEAD - n)], 1):
                        heads.append(step | {"fp": _bytes((h * pow(base, k, PRIME) + _int(step["fp"])) % PRIME)})
                    h = (h * pow(base, p["n"], PRIME) + _int(p["product"])) % PRIME
                    n += p["n"]
                out.append({"conv_id": conv, "n": n, "heads": heads, "segs": segs})
            yield pa.RecordBatch.from_pylist(out, _CONVS)

    return job


STEPS = "conv_id long, d long, fp binary, up binary, at long, size long, ends boolean"


def _tails(seed: int):
    base = base_of(seed)

    def job(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each own turn after the head: its depth, the fingerprint up to it and up to the one before."""
        for batch in batches:
            rows = batch.column("rows")
            items, offsets = rows.flatten(), _offsets(rows)
            elements, ats, sizes = _elements(items), items.field("at").to_pylist(), items.field("size").to_pylist()
            given = [batch.column(c).to_pylist() for c in ("conv_id", "start", "prefix", "n", "h", "taken", "head", "own_head")]
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for conv, start, prefix, n, h, taken, head, own, i, j in zip(*given, offsets, offsets[1:], strict=False):
                p, delta, head_fp = _int(prefix), (_int(head) - _int(own)) % PRIME, head
                shift = delta * pow(base, start - h, PRIME) % PRIME if start >= h else delta
                fp = _bytes((p + shift) % PRIME) if start > h else head_fp
                for k in range(start, start + j - i):
                    p = (p * base + elements[i + k - start]) % PRIME
                    if k < h:
                        continue
                    shift = shift * base % PRIME
                    up, fp = fp, _bytes((p + shift) % PRIME)
                    for column, x in zip(out, (conv, taken + k - h + 1, fp, up, ats[i + k - start], sizes[i + k - start], k == n - 1), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in STEPS.split(", ")])

    return job


def steps(ordered: DataFrame, base_id: F.Column, head: F.Column, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(steps, conversations): every turn of every rebuilt conversation by its prefix's fingerprint.

    ``base_id`` and ``head`` (at most HEAD) tell whose turns, and how many, come first. Steps: conv_id, d, fp, up (that of the
    prefix before), at (the stored turn), size, ends. Conversations: conv_id and the length it's rebuilt to.
    """
    h1, h2 = text_hash("role", "text")
    rows = ordered.select("conv_id", "at", h1.alias("h1"), h2.alias("h2"), F.char_length("text").cast("long").alias("size"))
    segs = written(segments(rows, h1=F.col("h1"), h2=F.col("h2"), size=F.col("size")), "segments")
    parts = segs.mapInArrow(_products(seed), PARTS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("sid", "n", "product", "heads"))).alias("parts"))
    convs = written(parts.mapInArrow(_conversations(seed), CONVS), "conversations")
    bases = convs.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    asked = convs.select("conv_id", "n", "heads", "segs", base_id.alias("base_id"), head.cast("long").alias("h")).join(bases, "base_id", "left")
    taken, root = F.least("h", F.coalesce("base_n", F.lit(0))), F.lit(ROOT)

    def upto(heads: str, k: F.Column) -> F.Column:
        return F.when(k > 0, F.col(heads)[(k - 1).cast("int")]["fp"]).otherwise(root)

    own_left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    plan = asked.withColumn("taken", taken).select(
        "conv_id", "n", "h", "taken", "segs", F.slice("base_heads", F.lit(1), F.col("taken").cast("int")).alias("base_heads"),
        upto("base_heads", F.col("taken")).alias("head"), F.when(own_left > 0, upto("heads", F.col("h"))).alias("own_head"), (F.col("taken") + own_left).alias("depth"),
    )
    plan = written(plan, "heads")
    up = F.when(F.col("k") > 0, F.col("base_heads")[F.col("k") - 1]["fp"]).otherwise(root)
    heads = plan.filter("taken > 0").select("conv_id", "depth", "base_heads", F.posexplode("base_heads").alias("k", "s"))
    heads = heads.select("conv_id", (F.col("k") + 1).cast("long").alias("d"), "s.fp", up.alias("up"), "s.at", "s.size", (F.col("k") + 1 == F.col("depth")).alias("ends"))
    mine = plan.filter("n > h").select("conv_id", "n", "h", "taken", "head", "own_head", F.explode("segs").alias("s")).select("*", "s.sid", "s.start", "s.prefix").drop("s", "conv_id")
    tails = segs.join(mine, "sid").mapInArrow(_tails(seed), STEPS)
    return written(heads.unionByName(tails), "steps"), plan.select("conv_id", "depth")


def unequal(steps: DataFrame, nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Nodes whose members' prefixes differ: in the turn they refer to, or in what comes before."""
    several = nodes.filter("at < last_at").select("d", "fp")
    places = steps.join(several, ["d", "fp"]).select("d", "fp", "at").distinct()
    texts = places.join(ordered.select("at", "role", "text"), "at").groupBy("d", "fp").agg(F.min("role").alias("a"), F.max("role").alias("b"), F.min("text").alias("x"), F.max("text").alias("y"))
    return texts.filter("a <> b or x <> y").select("d", "fp").unionByName(nodes.filter("up <> last_up").select("d", "fp"))


def nodes_of(steps: DataFrame) -> DataFrame:
    """(d, fp, conv_id, n_convs, up, size, ...) of each node but the root."""
    least_most = [F.min("up").alias("up"), F.max("up").alias("last_up"), F.min("at").alias("at"), F.max("at").alias("last_at")]
    return steps.groupBy("d", "fp").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *least_most, F.max("size").alias("size"))


def totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) with those of all chains below, from (conv_id, parent, leaves, saved).

    After a round, sums reach twice as far down and ``parent`` is twice as far up.
    """
    now = written(chains, "chains")
    while now.filter("parent is not null").limit(1).count():
        below = now.filter("parent is not null").groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        jumps = now.filter("parent is not null").select(F.col("conv_id").alias("parent"), F.col("parent").alias("next"))
        summed = now.join(below, "conv_id", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        now = written(summed.join(jumps, "parent", "left").select("conv_id", F.col("next").alias("parent"), "leaves", "saved"), "chains")
    return now.select("conv_id", "leaves", "saved")


def backwards(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, d, leaves, saved) with sums over each d and all larger ones, in two levels."""
    block = F.shiftright("d", BLOCK_BITS).alias("block")
    sums = rows.groupBy("conv_id", block).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select("conv_id", "block", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("block", block).withColumns({"leaves": F.sum("leaves").over(inside), "saved": F.sum("saved").over(inside)})
    return own.join(after, ["conv_id", "block"]).withColumns({"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}).drop("block", "l", "s")


def _hashed_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted rows (conv_id, depth, ids), joined by commas; a node's ids are never held together."""
    now, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if key == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                yield done()
            now, digest = key, hashlib.sha256(ids.encode())
    if now is not None:
        yield done()


def ends_of(steps: DataFrame, lengths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where rebuilt conversations end; ids meet in blocks of numbers."""
    ended = steps.filter("ends").select("d", "fp", "conv_id").unionByName(lengths.filter("depth = 0").select(F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("fp"), "conv_id"))
    blocks = ended.groupBy("d", "fp", F.shiftright("conv_id", IDS_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    placed = blocks.join(nodes.select("d", "fp", "conv_id"), ["d", "fp"]).select("conv_id", F.col("d").alias("depth"), "block", "ids")
    return placed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").mapInArrow(_hashed_ids, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, base_id: F.Column, head: F.Column) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(conversations.sparkSession)
    ids = [F.col(c).cast("long") for c in ("conv_id", "turn")]
    ordered = in_order(conversations.filter("conv_id is not null").select(*ids, *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))))
    for seed in range(8):
        all_steps, lengths = steps(ordered, base_id, head, seed)
        nodes = written(nodes_of(all_steps), "nodes")
        if not unequal(all_steps, nodes, ordered).limit(1).count():
            break
    else:
        raise RuntimeError("prefixes of one fingerprint differ under every base")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("fp"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("size"))
    nodes = written(nodes.select("d", "fp", "conv_id", "n_convs", "up", "size").unionByName(root), "nodes")

    tops = nodes.groupBy("conv_id").agg(F.min("d").alias("d"), F.max("d").alias("deepest"), F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    tops = nodes.select("conv_id", "d", "up").join(tops, ["conv_id", "d"])
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("fp").alias("up"), F.col("conv_id").alias("parent"))
    chains = written(tops.join(parents, ["d", "up"], "left").select("conv_id", "d", "deepest", "saved", "parent"), "chains")
    hung = chains.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("hung"))
    ends = chains.select("conv_id", F.col("deepest").alias("d")).join(hung, ["conv_id", "d"], "left").select("conv_id", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    own = chains.join(ends, "conv_id").select("conv_id", "parent", "leaves", "saved")
    below = totals(own).join(chains.select("conv_id", "parent", "d"), "conv_id").filter("parent is not null")
    below = below.groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))

    each = nodes.join(chains.select("conv_id", F.col("d").alias("top"), "deepest", "parent"), "conv_id").join(below, ["conv_id", "d"], "left")
    last, hung = F.col("d") == F.col("deepest"), F.coalesce("hung", F.lit(0))
    each = each.select(
        "conv_id", "d", "n_convs", F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), (hung + F.when(last, 0).otherwise(1)).alias("n_children"),
        F.coalesce("l", F.when(last, 1).otherwise(0)).cast("long").alias("leaves"), (F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    out = backwards(each).select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    digests = ends_of(all_steps, lengths, nodes)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie where conversation c begins with the first crc32(c) mod 6 turns of c - c mod 100."""
    c = F.col("conv_id")
    return trie(conversations, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6)
