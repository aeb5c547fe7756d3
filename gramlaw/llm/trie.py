"""Prefix trie of conversations, built by truncation peeling.

Conversations are rebuilt as sequences of turns (a digest of role and text, and a number of words); equal ones become one
row with their number and least id. From the greatest depth on, conversations that end there join the nodes that survive
from below, the last turn is stripped and what is then equal is one node of the next depth: nodes are found and their sums
are made in the same pass, whose work is the number of nodes.

Rows are sorted by their sequence over range partitions, so that a task peels a contiguous part of the trie, in slices of
about ``SLICE`` turns. Only nodes on the first and last sequence of a slice can reach into another one. These stay open: a
slice hands on these two sequences, each with the sums of what is closed beside it at every depth, and the same function
peels them again, in ranges while they are many, at last in one task (at most ``LAST`` turns). So the number of rounds
depends on neither depth nor skew, and a common first turn or conversation is spread like any other. What then closes
names the parents of nodes whose parents were open; they meet in a join by slice.

The digest of the ids that end at a node is one sequential SHA-256. Ids are sorted over range partitions and go on as
strings of many ids, which are streamed through the hash, so memory is bounded also where a third of all end at one node.

Results for odd input: rows without conv_id belong to no conversation and are left out. Null role or text is empty. A null
turn comes first; equal turns are ordered by the digest of role and text, so repeated rows are turns of their own. A
conversation may be left without turns and then ends at the root. An empty table has no nodes. Other columns are not read.
The digests of one conversation's turns must fit into a task (16 bytes a turn); its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import SPACE, cut
from gramlaw.session import prepare

SLICE, LAST, LEAST_ROWS = 1 << 17, 1 << 20, 16
CHUNK = 1 << 14  # ids in one string
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
SUMS = ("n", "least", "children", "leaves", "saved")
ROW = pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int64())), ("slice", pa.int64()), ("side", pa.int32()), ("at", pa.list_(pa.int64())), *[(k, pa.list_(pa.int64())) for k in SUMS], ("ends", pa.list_(pa.string()))])
NODE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
LINK = pa.schema([("from_slice", pa.int64()), ("from_side", pa.int32()), ("at_depth", pa.int64()), ("to_slice", pa.int64()), ("to_side", pa.int32()), ("known", pa.int64())])
OUT = pa.schema([("kind", pa.int32()), *NODE, ("in_slice", pa.int64()), ("in_side", pa.int32()), *[pa.field(f"row_{f.name}", f.type) for f in ROW], *LINK])
NODES, ROWS, LINKS = 0, 1, 2
SQL = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL[f.type]}" for f in schema)


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): the turns of each rebuilt conversation as joined 16-byte digests, and their words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("md5"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"))
    own = conversations.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    h = shared_head(F.col("conv_id")).cast("int")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "_base", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    all_turns = F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", all_turns.alias("turns")).select("conv_id", F.unhex(F.array_join("turns.md5", "")).alias("path"), F.col("turns.words").alias("words"))


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends, n, least) of each distinct key; ``rows``: key, conv_id. ``ends`` is the SHA-256 of the ids in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
        for b in batches:
            keys, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            first = np.unique(np.concatenate([first, np.arange(0, len(ids), CHUNK)]))
            text = ids.astype(str)
            stop = np.append(first[1:], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(ids[first]), pa.array(stop - first), pa.array([",".join(text[a:z]) for a, z in zip(first, stop, strict=True)])], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("ends", pa.string()), ("n", pa.int64()), ("least", pa.int64())])
        key = sha = None
        n = least = 0
        for b in batches:
            out = []
            for k, low, count, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    n += count
                    continue
                if key is not None:
                    out.append((key, sha.hexdigest(), n, least))
                key, sha, n, least = k, hashlib.sha256(ids.encode()), count, low
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, sha.hexdigest(), n, least)], schema=schema)

    parts = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, "key string, least long, n long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "least").mapInArrow(hashed, "key string, ends string, n long, least long")


def _shared(size: np.ndarray, at: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the row before it; -1 for the first row."""
    out = size.copy()
    k = np.arange(len(digest)) - np.repeat(at[:-1], size)
    before = np.repeat(np.concatenate([[0], at[:-2]]), size) + k
    room = k < np.repeat(np.concatenate([[0], size[:-1]]), size)
    same = room & (digest[np.where(room, before, 0)] == digest).all(axis=1)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.minimum(size[full], np.minimum.reduceat(np.where(same, NONE, k), at[:-1][full]))
    out[0] = -1
    return out


def peel(size: np.ndarray, digest: np.ndarray, words: np.ndarray, extra: dict[str, np.ndarray], final: bool) -> tuple[dict, dict, dict]:
    """Peel one slice of sorted distinct sequences from the greatest depth to the root.

    ``extra``: row, depth, ``SUMS`` and ``ends`` (whether any ended there) of what counts at one depth of one row without
    coming from a node below it; every row has one at its full depth. Returns closed nodes, with ``side`` telling an open
    parent (-1: none) and ``extra`` the entry with the ends; the sums of open nodes by side; per extra what became of its
    node (``side``, or -1 and ``known``, the least id)."""
    at = np.concatenate([[0], np.cumsum(size)])
    shared = _shared(size, at, digest)
    order = np.lexsort((extra["row"], -extra["depth"]))
    sorted_depth = -extra["depth"][order]
    rep, was_open = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    state = {k: np.zeros(0, dtype=np.int64) for k in (*SUMS, "extra")}
    nodes, opened = [], []
    fate = {"side": np.full(len(order), -1), "known": np.zeros(len(order), dtype=np.int64)}

    def closed(depth, parent, side):
        shut = ~was_open
        return {"depth": np.full(int(shut.sum()), depth), "parent": parent, "side": side, **{k: v[shut] for k, v in state.items()}}

    for d in range(int(size.max()), -1, -1):
        e = order[np.searchsorted(sorted_depth, -d) : np.searchsorted(sorted_depth, -d, side="right")]
        rows = np.concatenate([rep, extra["row"][e]])
        place = np.argsort(rows, kind="stable")
        r = rows[place]
        first = shared[r] < d
        first[1:] &= r[1:] != r[:-1]
        group = np.empty(len(r), dtype=np.int64)
        group[place] = np.cumsum(first) - 1
        head, shut = r[first], ~was_open
        below, here = group[: len(rep)][shut], group[len(rep) :]
        new = {k: np.full(len(head), NONE if k == "least" else 0, dtype=np.int64) for k in SUMS}
        for k in SUMS:
            put = np.minimum.at if k == "least" else np.add.at
            put(new[k], here, extra[k][e])
            put(new[k], below, 1 if k == "children" else state[k][shut])
        new["extra"] = np.full(len(head), -1)
        ended = extra["ends"][e]
        new["extra"][here[ended]] = e[ended]
        still, side = np.zeros(len(head), dtype=bool), np.full(len(head), -1)
        if not final:
            still[-1] = size[-1] >= d
            still[0] |= size[0] >= d
            side = np.where(still, 1, -1)
            side[0] = 0 if size[0] >= d else side[0]
        nodes.append(closed(d + 1, np.where(still, -1, new["least"])[below], side[below]))
        opened.append({"depth": np.full(int(still.sum()), d), "side": side[still], **{k: new[k][still] for k in new}})
        word = words[at[head] + d - 1] if d else np.zeros(len(head), dtype=np.int64)
        new["leaves"] = np.where(new["children"] == 0, 1, new["leaves"])
        new["saved"] = new["saved"] + (new["n"] - 1) * word
        fate["side"][e], fate["known"][e] = side[here], new["least"][here]
        rep, was_open, state = head, still, new
    nodes.append(closed(0, np.full(int((~was_open).sum()), -1), np.full(int((~was_open).sum()), -1)))
    both = lambda parts: {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    return both(nodes), both(opened), fate


def _batch(kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), **columns}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in OUT], schema=OUT)


def _peeled(table: pa.Table, name: int, final: bool) -> Iterator[pa.RecordBatch]:
    """The nodes, open rows and links of one slice of ``ROW`` rows."""
    table = table.combine_chunks()
    col = {f: table.column(f).chunk(0) if table.column(f).num_chunks else pa.array([], ROW.field(f).type) for f in ROW.names}
    size = pc.binary_length(col["path"]).to_numpy().astype(np.int64) // 16
    digest = np.frombuffer(b"".join(col["path"].to_pylist()), dtype=np.uint64).reshape(-1, 2)
    flat = lambda c: col[c].flatten()
    number = lambda c: flat(c).to_numpy(zero_copy_only=False).astype(np.int64)
    text = flat("ends")
    of = np.repeat(np.arange(len(size)), pc.list_value_length(col["at"]).to_numpy(zero_copy_only=False))
    extra = {"row": of, "depth": number("at"), **{k: number(k) for k in SUMS}, "ends": pc.is_valid(text).to_numpy(zero_copy_only=False)}
    words = number("words")
    node, still, fate = peel(size, digest, words, extra, final)

    def texts(at):
        return pc.take(text, pa.array(at, mask=at < 0))

    for lo in range(0, len(node["depth"]), 1 << 16):
        part = {k: v[lo : lo + (1 << 16)] for k, v in node.items()}
        waits, top = part["side"] >= 0, part["depth"] == 0
        yield _batch(
            NODES,
            {
                "conv_id": pa.array(part["least"]),
                "depth": pa.array(part["depth"]),
                "parent_conv_id": pa.array(part["parent"], mask=waits | top),
                "n_convs": pa.array(part["n"]),
                "n_children": pa.array(part["children"]),
                "n_leaves": pa.array(part["leaves"]),
                "saved_tokens": pa.array(part["saved"]),
                "ends_sha256": pc.fill_null(texts(part["extra"]), NO_ENDS),
                "in_slice": pa.array(np.full(len(waits), name), mask=~waits),
                "in_side": pa.array(part["side"], mask=~waits),
            },
        )
    for side in (0, 1):
        mine = still["side"] == side
        if mine.any():
            one = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
            row = col["path"].slice(0 if side == 0 else len(size) - 1, 1)
            own = col["words"].slice(0 if side == 0 else len(size) - 1, 1)
            sums = {f"row_{k}": one(still[k][mine]) for k in SUMS}
            yield _batch(ROWS, {"row_path": row, "row_words": own, "row_slice": pa.array([name]), "row_side": pa.array([side]), "row_at": one(still["depth"][mine]), **sums, "row_ends": one(texts(still["extra"][mine]).to_pylist(), pa.string())})
    if col["slice"].null_count < len(size):
        goes = fate["side"] >= 0
        ref = lambda c: pc.take(col[c], pa.array(of))
        yield _batch(LINKS, {"from_slice": ref("slice"), "from_side": ref("side"), "at_depth": pa.array(extra["depth"]), "to_slice": pa.array(np.full(len(of), name), mask=~goes), "to_side": pa.array(fate["side"], mask=~goes), "known": pa.array(fate["known"], mask=goes)})


def _round(rows: DataFrame, final: bool, ranges: int | None) -> DataFrame:
    """One round of peeling over sorted ``ROW`` rows, in so many ranges (as many as a shuffle has, if not given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            turns += pc.sum(pc.binary_length(b.column(0))).as_py() // 16
            if not final and turns >= SLICE and sum(x.num_rows for x in held) >= LEAST_ROWS:
                yield from _peeled(pa.Table.from_batches(held), name, False)
                name, held, turns = name + 1, [], 0
        if held:
            yield from _peeled(pa.Table.from_batches(held), name, final)

    ordered = rows.select(*ROW.names)
    if final:
        ordered = ordered.coalesce(1)
    else:
        ordered = ordered.repartitionByRange(*([ranges] if ranges else []), "path")
    return cut(ordered.sortWithinPartitions("path").mapInArrow(run, _ddl(OUT)), "peeled")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    each = cut(rebuilt(conversations).withColumn("key", F.md5("path")), "rebuilt")
    kinds = each.groupBy("key").agg(F.any_value("path").alias("path"), F.any_value("words").alias("words"))
    one = lambda c, t="long": F.array(c.cast(t) if isinstance(c, Column) else F.lit(c).cast(t))
    rows = kinds.join(ends(each.select("key", "conv_id")), "key")
    sums = {"n": F.col("n"), "least": F.col("least"), "children": 0, "leaves": 0, "saved": 0}
    rows = rows.select("path", "words", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("int").alias("side"), one(F.size("words")).alias("at"), *[one(v).alias(k) for k, v in sums.items()], F.array("ends").alias("ends"))
    rounds, rows, final, ranges = [], cut(rows, "kinds"), False, None
    while True:
        out = _round(rows, final, ranges)
        rounds.append(out)
        if final:
            break
        rows = out.where(F.col("kind") == ROWS).select(*[F.col(f"row_{c}").alias(c) for c in ROW.names])
        many = rows.agg(F.sum(F.length("path")).alias("bytes"), F.count("*").alias("rows")).first()
        final, ranges = (many["bytes"] or 0) <= 16 * LAST, many["rows"] // (4 * LEAST_ROWS) + 1  # a range hands on two rows
    place = ["in_slice", "in_side", "depth"]
    result = open_ones = None
    for out in reversed(rounds):
        nodes = out.where(F.col("kind") == NODES).select(*NODE.names, "in_slice", "in_side")
        if open_ones is not None:
            waiting = nodes.where("in_slice is not null").withColumn("depth", F.col("depth") - 1).drop("parent_conv_id").join(open_ones, place)
            waiting = waiting.withColumn("depth", F.col("depth") + 1).withColumnRenamed("known", "parent_conv_id")
            nodes = nodes.where("in_slice is null").unionByName(waiting)
        result = nodes.select(*NODE.names) if result is None else result.unionByName(nodes.select(*NODE.names))
        links = out.where(F.col("kind") == LINKS).select(*LINK.names)
        ready = links.where("known is not null").select("from_slice", "from_side", "at_depth", "known")
        if open_ones is not None:
            on = [F.col("to_slice") == F.col("in_slice"), F.col("to_side") == F.col("in_side"), F.col("at_depth") == F.col("depth")]
            ready = ready.unionByName(links.where("known is null").drop("known").join(open_ones, on).select("from_slice", "from_side", "at_depth", "known"))
        open_ones = ready.toDF(*place, "known")
    return result
