"""Chat formatting with a prefix tree.

Conversations that share their first turns share those turns' tokens.  Conversations are sorted by
the sequence of the hashes of all their turns, over the whole table, so that those with a common prefix of any length
stand together; each task walks its range in that order and packs
neighbours into bounded sequences.  In a pack every distinct prefix is a node whose tokens are
emitted once, depth first.  A node carries its position id (the tokens in front of it on its own
path) and its attention intervals: the token ranges of its ancestors, all that its tokens may see
besides earlier tokens of the node itself.  A leaf names its conversations.

A first turn that a third of all conversations share is no group of its own: it is split over as
many ranges and packs as its conversations need, and is emitted once in each.  There are as many ranges as the bytes ask for
(``RANGE_BYTES`` each), so a small table is one range.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks).  In roles and texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|`` (in roles a line break becomes ``\\n``), so a text can never hold a control
string, and reading turns it back.  The loss covers the escaped texts of the assistant.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, materialize, table

START, END = "<|im_start|>", "<|im_end|>"
PACK_TOKENS = 32_768
PACK_CONVERSATIONS = 256
RANGE_BYTES = 4 << 20

PACK = (
    "ids array<int>, position_ids array<int>, loss array<boolean>, "
    "nodes array<struct<start:int,stop:int,parent:int,position:int,sees:array<struct<start:int,stop:int>>>>, leaves array<struct<conv_id:long,node:int>>"
)
_NODE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("sees", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, str, str]:
    """(header, body, footer) of a turn."""
    return START + escape(role).replace("\n", "\\n") + "\n", escape(text), END + "\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; ValueError where it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        stop = formatted.find(END + "\n", at)
        if not formatted.startswith(START, at) or stop < 0:
            raise ValueError(f"no turn at character {at}")
        role, line, body = formatted[at + len(START) : stop].partition("\n")
        if not line:
            raise ValueError(f"a turn without a role at character {at}")
        turns.append((unescape(role), unescape(body)))
        at = stop + len(END) + 1
    return turns


class _Tokens:
    """Byte-level tokens of strings; control strings are ordinary text to the vocabulary."""

    def __init__(self, path: str):
        import tokenizers

        self.t = tokenizers.Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.t.no_truncation()
        self.t.no_padding()

        self.seen: dict[str, np.ndarray] = {}

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.t.encode_batch(parts, add_special_tokens=False)]

    def frame(self, part: str) -> np.ndarray:
        """The tokens of a header or footer; there are few different ones."""
        if part not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[part] = self.encode([part])[0]
        return self.seen[part]

    def decode(self, ids) -> str:
        return self.t.decode(ids.tolist(), skip_special_tokens=False)


_loaded: dict[str, _Tokens] = {}


def _tokens(path: str) -> _Tokens:
    if path not in _loaded:
        _loaded[path] = _Tokens(path)
    return _loaded[path]


class _Pack:
    """A prefix tree under construction; nodes come in depth-first order because conversations come sorted by prefix."""

    def __init__(self):
        self.nodes, self.of, self.parts, self.loss, self.leaves, self.size = [], {}, [], [], [], 0

    def add(self, conv_id, turns, tokens: _Tokens):
        parent, key, new = -1, b"", []
        for role, text in turns:
            key = hashlib.sha256(key + b"\0" + role.encode() + b"\n" + text.encode()).digest()
            if key in self.of:
                parent = self.of[key]
                continue
            self.of[key] = len(self.nodes)
            self.nodes.append([parent, None])
            new.append((self.of[key], role, text))
            parent = self.of[key]
        if new:
            rendered = [render_turn(role, text) for _, role, text in new]
            for (node, role, _), (head, _, foot), b in zip(new, rendered, tokens.encode([body for _, body, _ in rendered])):
                h, f = tokens.frame(head), tokens.frame(foot)
                self.parts += [h, b, f]
                self.loss += [np.zeros(len(h), bool), np.full(len(b), role == "assistant"), np.zeros(len(f), bool)]
                size = len(h) + len(b) + len(f)
                self.nodes[node][1] = (self.size, self.size + size)
                self.size += size
        self.leaves.append((conv_id, parent))

    def batch(self) -> pa.RecordBatch:
        out, seen = [], []
        position_ids = np.zeros(self.size, np.int32)
        for parent, (start, stop) in self.nodes:
            # the parent's range closes the list of what a node sees; neighbours in the text are one range
            sees = [] if parent < 0 else [*seen[parent]]
            if parent >= 0:
                a, b = self.nodes[parent][1]
                if sees and sees[-1][1] == a:
                    sees[-1] = (sees[-1][0], b)
                else:
                    sees.append((a, b))
            seen.append(sees)
            position = sum(b - a for a, b in sees)
            position_ids[start:stop] = np.arange(position, position + stop - start)
            out.append({"start": start, "stop": stop, "parent": parent, "position": position, "sees": [{"start": a, "stop": b} for a, b in sees]})
        none = np.zeros(0, np.int32)
        loss = np.concatenate(self.loss) if self.loss else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays(
            [list_array([np.concatenate(self.parts) if self.parts else none], np.int32), list_array([position_ids], np.int32), pa.array([loss.tolist()], pa.list_(pa.bool_())), pa.array([out], pa.list_(_NODE)), pa.array([[{"conv_id": c, "node": n} for c, n in self.leaves]], pa.list_(_LEAF))],
            ["ids", "position_ids", "loss", "nodes", "leaves"],
        )


def gather(turns: DataFrame) -> DataFrame:
    """``(conv_id, key, bytes, turns)``: one row per conversation id, its turns in order of (turn, role, text).

    Null roles and texts are empty; rows without a turn number come first; repeated rows are turns of their own;
    rows without an id are one conversation with a null id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    names = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # turns have keys of equal width, so the order of keys is that of a depth-first walk
    key = F.array_join(F.transform("t", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    size = F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["role"]) + F.octet_length(t["text"]))
    return whole.select("conv_id", key.alias("key"), size.alias("bytes"), names.alias("turns"))


def build_packs(conversations: DataFrame, tokenizer: str, pack_tokens: int = PACK_TOKENS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs (see ``PACK``) of the written ``conversations(conv_id, key, bytes, turns)``; a conversation longer than a pack is a pack of its own."""

    def run(batches):
        tokens, pack = _tokens(tokenizer), _Pack()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                turns = [(t["role"], t["text"]) for t in row.column(1)[0].as_py()]
                pack.add(row.column(0)[0].as_py(), turns, tokens)
                if pack.size >= pack_tokens or len(pack.leaves) >= pack_conversations:
                    yield pack.batch()
                    pack = _Pack()
        if pack.leaves:
            yield pack.batch()

    n = max(1, -(-(conversations.agg(F.sum("bytes")).first()[0] or 0) // RANGE_BYTES))
    dealt = conversations.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(run, PACK)


def read_packs(packs: DataFrame, tokenizer: str) -> DataFrame:
    """What packs say of each conversation: turns read back along its path, and the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        tokens = _tokens(tokenizer)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids, positions = (row.column(k)[0].values.to_numpy() for k in (0, 1))
                loss = row.column(2)[0].values.to_numpy(zero_copy_only=False)
                nodes, out, text_of, loss_of = row.column(3)[0].as_py(), [], {}, {}
                for leaf in row.column(4)[0].as_py():
                    path, node = [], leaf["node"]
                    while node >= 0:
                        path.append(node)
                        node = nodes[node]["parent"]
                    path.reverse()
                    for node in path:
                        if node not in text_of:
                            x = slice(nodes[node]["start"], nodes[node]["stop"])
                            text_of[node] = tokens.decode(ids[x])
                            loss_of[node] = unescape(tokens.decode(ids[x][loss[x]])) if loss[x].any() else ""
                    last = nodes[path[-1]]
                    seen = np.concatenate([np.arange(s["start"], s["stop"]) for s in last["sees"]] + [np.arange(last["start"], last["stop"])])
                    if not np.array_equal(positions[seen], np.arange(len(seen))):
                        raise ValueError("the position ids of a path are not its own")
                    formatted, learned = "".join(text_of[n] for n in path), "".join(loss_of[n] for n in path)
                    turns = parse(formatted)
                    digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                    out.append((leaf["conv_id"], len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = END + START + "assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    packs = materialize(build_packs(materialize(gather(rows), "conversations"), default_tokenizer()), "packs")
    return read_packs(packs, default_tokenizer())


_E = "replace(replace(%s, '\\', '\\\\'), '<|', '<\\|')"
ORACLE = {
    "op10_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length({_E % 'role'}) + length({_E % 'text'})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
