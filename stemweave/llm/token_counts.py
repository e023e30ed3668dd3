"""Token counts with a finite-state counter for a word-level byte-pair vocabulary.

The vocabulary is compiled into a deterministic transducer over bytes whose transitions carry token counts.

*States.*  In byte-pair encoding the tokens of a prefix end in one token, and what is in front of it is the encoding of what
is in front of it.  Two tokens may stand side by side in an encoding exactly where no merge crosses them earlier than
their own merges, which the derivations of both tell (``fits``).  So all that later bytes need to know of a word read so far is the
longest ending that may still grow into a token, and, for each place inside it, the last token of the encoding up to there and how
many tokens that is fewer than now.  This is a state.  A transition reads a byte, moves to a state, and adds the change in the
number of tokens (it may be negative, where tokens merge); an end transition reads the last byte of a word.  Transitions are
determinised when they are first met and kept in dense tables; no merge is ever run on a text.

*Chunks.*  White space, a change of the kind of characters and special strings close a word, and there all states meet.
What a chunk of text does to the state it is entered with is therefore a small map: the bytes up to the first such
place (which continue an open word), the tokens behind them, and the state in which the chunk is left.  State maps
compose associatively.  Every text is cut into chunks, and the maps of its chunks are composed by a prefix scan; the chunks of very
long texts are dealt over tasks before.  A chunk in which no word ends has its bytes for a map, so what is gathered of a text is at most as large as the text.

The counts are those of the ``tokenizers`` library for the same file (no begin, end or added special tokens; special
strings inside a text are one token each, the library's default).
"""

from __future__ import annotations

import json
import math
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

CHUNK = 1 << 12
LONG = 1 << 20
STATES = 120_000
LOCKSTEP = 256
SHIFT = 64
SPACE, LETTER, NUMBER, OTHER = range(4)
#: a text may be cut in front of these: nothing in front of them changes them in normalisation, and no contraction spans the place
_CUT = regex.compile(r"(?<!'.{0,2})[\x00-\x26\x28-\x7fぁ-ゖァ-ヺ㐀-鿿가-힣]", regex.S)
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Open(NamedTuple):
    """A word that is open at the edge of a chunk: its kind, the state before its last byte, and that byte."""

    kind: int
    state: int
    byte: int


class StateMap(NamedTuple):
    """What a chunk does to the state it is entered with.

    ``head`` is the word of ``kind`` at its very start, which may continue an open one.  Unless ``closed``, it is the whole chunk.
    ``count`` tokens lie between the head and the word ``tail`` that the chunk leaves open (None: it ends at a boundary).
    """

    kind: int
    head: bytes
    closed: bool
    count: int
    tail: Open | None


IDENTITY = StateMap(SPACE, b"", False, 0, None)


class CountTransducer:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end, letters = model["end_of_word_suffix"], _byte_letters()
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not end or patterns != [_WORD_PATTERN] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a vocabulary of this kind")
        self.letters, self.ends = letters, [c + end for c in letters]
        if any(c not in model["vocab"] for c in self.letters + self.ends):
            raise ValueError("the vocabulary lacks a byte")
        if max(map(len, model["vocab"])) >= SHIFT:
            raise ValueError("a token is too long for the tables")
        self.parts: dict[str, tuple[str, str, int]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b in self.parts or max(self._made(a), self._made(b)) >= i:
                raise ValueError(f"merge {i} makes a token twice or before its parts")
            self.rank[a, b] = i
            self.parts[a + b] = (a, b, i)
        self.fit: dict[tuple[str, str], bool] = {}
        # tokens that encode to themselves, and what is read before their last symbol
        self.tokens, self.growing = set(self.letters + self.ends), set()
        for t, (a, b, i) in self.parts.items():
            if a in self.tokens and b in self.tokens and not self._crossed(a, b, i):
                self.tokens.add(t)
                body = t[: -len(end)] if t.endswith(end) else t
                self.growing.update(body[:k] for k in range(1, len(body)))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.longest_special = max(map(len, special), default=0)
        self.kind_of = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"[\t-\r\x85\p{Z}]")):
            self.kind_of[[ord(c) for c in regex.findall(pattern, every)]] = kind
        self._clear()

    # ----------------------------------------------------------------- compilation

    def _made(self, token: str) -> int:
        return self.parts[token][2] if token in self.parts else -1

    def _crossed(self, a: str, b: str, limit: float) -> bool:
        """Whether a merge across ``a | b`` comes before both are whole, or before merge ``limit`` afterwards."""
        right, x, until = [], a, limit
        while True:  # the last parts of a, each with the merge that ends it
            right.append((x, until))
            if x not in self.parts:
                break
            _, x, until = self.parts[x]
        y, until = b, limit
        while True:
            for x, gone in right:
                q = self.rank.get((x, y))
                # of equal merges the leftmost is first: one inside a is before the crossing, one inside b behind it
                if q is not None and q < gone and q <= until and (q < limit or (x, y) != (a, b)):
                    return True
            if y not in self.parts:
                return False
            y, _, until = self.parts[y]

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        got = self.fit.get((a, b))
        if got is None:
            if len(self.fit) > 1_000_000:
                self.fit.clear()
            got = self.fit[a, b] = not self._crossed(a, b, math.inf)
        return got

    def _clear(self):
        """An empty table of states; the first one is that of no word."""
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        # zeros take no memory until they are written: 0 is "not met yet", next is kept plus 1 and last plus SHIFT
        self.next, self.gain, self.last = (np.zeros((1 << 17, 256), kind) for kind in (np.int32, np.int8, np.int8))
        self.state((("", ((None, 0),))))

    def state(self, key: tuple) -> int:
        """The number of a state; states are (ending that may grow, ((last token, fewer tokens) for each place in it))."""
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if got >= len(self.next):
                self.next, self.gain, self.last = (np.concatenate((a, np.zeros_like(a))) for a in (self.next, self.gain, self.last))
        return got

    def _ending(self, state: int, symbol: str) -> tuple[str, int]:
        """(last token, change in the number of tokens) when ``symbol`` is read."""
        ending, places = self.keys[state]
        for k, (token, fewer) in enumerate(places):
            t = ending[k:] + symbol
            if t in self.tokens and (token is None or self.fits(token, t)):
                return t, fewer + 1
        raise AssertionError("every encoding has a last token")

    def _step(self, state: int, byte: int):
        ending, places = self.keys[state]
        token, gain = self._ending(state, self.letters[byte])
        grown = ending + self.letters[byte]
        k = 0
        while k < len(grown) and grown[k:] not in self.growing:
            k += 1
        seen = [*((t, n - gain) for t, n in places), (token, 0)]
        self.gain[state, byte] = gain
        self.next[state, byte] = self.state((grown[k:], tuple(seen[k:]))) + 1

    def _finish(self, state: int, byte: int):
        self.last[state, byte] = self._ending(state, self.ends[byte])[1] + SHIFT

    # --------------------------------------------------------------------- running

    def advance(self, state: int, data: bytes) -> tuple[int, int]:
        """(state, tokens gained) after the bytes of a word, none of them its last."""
        total = 0
        for b in data:
            if not self.next[state, b]:
                self._step(state, b)
            total += int(self.gain[state, b])
            state = int(self.next[state, b]) - 1
        return state, total

    def end(self, state: int, byte: int) -> int:
        if not self.last[state, byte]:
            self._finish(state, byte)
        return int(self.last[state, byte]) - SHIFT

    def run_words(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The tokens of every word ``buf[start:stop]``: all words move one byte at a time together."""
        size = stop - start
        total = np.zeros(len(start), np.int64)
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -LOCKSTEP, "left"))
        for i in order[:long].tolist():  # few and long: one after the other
            state, total[i] = self.advance(0, buf[start[i] : stop[i] - 1].tobytes())
            total[i] += self.end(state, int(buf[stop[i] - 1]))
        order = order[long:]
        at, left = start[order], size[order]
        state, sums = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        more = len(order)
        for k in range(int(left[0]) if len(left) else 0):
            here, more = more, int(np.searchsorted(-left, -(k + 1), "left"))
            code = state[:here] * 256 + buf[at[:here] + k]
            ending = code[more:]
            got = self.last.ravel()[ending]
            if not got.all():
                for c in np.unique(ending[got == 0]).tolist():
                    self._finish(c >> 8, c & 255)
                got = self.last.ravel()[ending]
            sums[more:here] += got.astype(np.int64) - SHIFT
            going = code[:more]
            new = self.next.ravel()[going]
            if not new.all():
                for c in np.unique(going[new == 0]).tolist():
                    self._step(c >> 8, c & 255)
                new = self.next.ravel()[going]
            sums[:more] += self.gain.ravel()[going]
            state[:more] = new - 1
        total[order] = sums
        return total

    def _plain(self, text: str) -> tuple[str, int]:
        """The normalised text, with a line break for each special string, and how many there were."""
        n = 0
        if self.special is not None and "<" in text:
            text, n = self.special.subn("\n", text)
        if text.isascii():
            return text.lower(), n
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), n

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, word starts, word ends, kinds) of a normalised text."""
        buf = np.frombuffer(text.encode(), np.uint8)
        if len(buf) == len(text):
            code = buf
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind_of[code]
        fresh = np.ones(len(kind) + 1, bool)
        fresh[1:-1] = kind[1:] != kind[:-1]
        first = fresh[:-1] | (kind == NUMBER)
        for i in np.flatnonzero((code == 39) & fresh[:-1]).tolist():  # 's, 't, 're, 've, 'm, 'll, 'd
            after = text[i + 1 : i + 3]
            n = 2 if after in ("re", "ve", "ll") else 1 if after[:1] in ("s", "t", "m", "d") else 0
            if n:
                first[i + 1] = False
                kind[i : i + n + 1] = OTHER
                if i + n + 1 < len(first):
                    first[i + n + 1] = True
        starts = np.flatnonzero(first & (kind != SPACE))
        edge = np.flatnonzero(np.r_[first, True])
        stops = edge[np.searchsorted(edge, starts, "right")] if len(starts) else starts
        kinds = kind[starts]
        if code is not buf:
            size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            offset = np.r_[0, np.cumsum(size)]
            starts, stops = offset[starts], offset[stops]
        return buf, starts, stops, kinds

    # ------------------------------------------------------------------ state maps

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Edges of chunks of about ``chunk`` characters, from 0 to the length; each is at a place where the text may be cut."""
        edges = [0]
        while edges[-1] + chunk < len(text):
            at = edges[-1] + chunk
            while m := _CUT.search(text, at):
                at = m.start()
                inside = [s for s in self.special.finditer(text, max(at - self.longest_special, 0), at + self.longest_special) if s.start() < at < s.end()] if self.special else []
                if not inside:
                    break
                at = inside[0].end()
            if not m or at >= len(text):
                break
            edges.append(at)
        return [*edges, len(text)]

    def state_maps(self, chunks: list[str]) -> list[StateMap]:
        """The maps of some chunks (see :func:`cuts`); the words inside all of them move through the tables together."""
        plain, special = zip(*map(self._plain, chunks)) if chunks else ((), ())
        # a line break between two chunks closes a word, but what is at the edge of a chunk is looked at by itself
        buf, starts, stops, kinds = self._words("\n".join(plain))
        edges = np.cumsum([0] + [len(p.encode()) + 1 for p in plain])
        lo, hi = np.searchsorted(starts, edges[:-1]), np.searchsorted(starts, edges[1:])
        has = hi > lo
        first, last = np.where(has, lo, 0), np.where(has, hi - 1, 0)
        open_ = lambda at, side, edge: has & (side[at] == edge) & (kinds[at] != NUMBER) if len(starts) else has
        head, tail = open_(first, starts, edges[:-1]), open_(last, stops, edges[1:] - 1)
        tail &= ~(head & (first == last))
        inner = np.ones(len(starts), bool)
        inner[first[head]] = False
        inner[last[tail]] = False
        sums = np.bincount(np.searchsorted(edges, starts[inner], "right") - 1, self.run_words(buf, starts[inner], stops[inner]), minlength=len(chunks)).astype(np.int64)
        out = []
        for c in range(len(chunks)):
            if not chunks[c]:
                out.append(IDENTITY)
                continue
            count, begun, word = int(sums[c]) + special[c], b"", None
            if head[c]:
                begun = buf[starts[lo[c]] : stops[lo[c]]].tobytes()
                if stops[lo[c]] == edges[c + 1] - 1:
                    out.append(StateMap(int(kinds[lo[c]]), begun, False, count, None))
                    continue
            # a contraction at the end is whole: cuts stay clear of it, and at the end of a text nothing follows
            if tail[c]:
                k = hi[c] - 1
                state, gained = self.advance(0, buf[starts[k] : stops[k] - 1].tobytes())
                word, count = Open(int(kinds[k]), state, int(buf[stops[k] - 1])), count + gained
            out.append(StateMap(int(kinds[lo[c]]) if head[c] else SPACE, begun, True, count, word))
        return out

    def state_map(self, chunk: str) -> StateMap:
        """The map of one chunk."""
        return self.state_maps([chunk])[0]

    def fresh(self) -> None:
        """Start with empty tables where there are very many states; no map that was made before may be used behind this."""
        if len(self.keys) > STATES:
            self._clear()

    def counts(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """The tokens of whole texts: each is cut into chunks, and the maps of its chunks are composed by a prefix scan."""
        self.fresh()
        edges = [self.cuts(t, chunk) for t in texts]
        maps = self.state_maps([t[a:b] for t, e in zip(texts, edges) for a, b in zip(e, e[1:])])
        at = np.cumsum([0] + [len(e) - 1 for e in edges]).tolist()
        return np.array([self.total(self.scan(maps[a:b])[-1]) for a, b in zip(at, at[1:])], np.int64)

    def close(self, word: Open | None) -> int:
        return 0 if word is None else self.end(word.state, word.byte)

    def apply(self, m: StateMap, entry: Open | None) -> tuple[int, Open | None]:
        """(tokens, state) behind a chunk that is entered with an open word, or with none."""
        if not m.head and not m.closed:
            return 0, entry
        total, word = 0, entry
        if m.head:
            if entry is not None and entry.kind == m.kind:
                data, state = bytes([entry.byte]) + m.head, entry.state
            else:
                data, state, total = m.head, 0, self.close(entry)
            state, gained = self.advance(state, data[:-1])
            total, word = total + gained, Open(m.kind, state, data[-1])
            if not m.closed:
                return total, word
        return total + self.close(word) + m.count, m.tail

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        """The map of two neighbouring chunks."""
        if y == IDENTITY:
            return x
        if x == IDENTITY:
            return y
        if x.closed:
            total, word = self.apply(y, x.tail)
            return StateMap(x.kind, x.head, True, x.count + total, word)
        if y.head and y.kind == x.kind:
            return y._replace(head=x.head + y.head)
        total, word = self.apply(y, None)
        return StateMap(x.kind, x.head, True, total, word)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefix compositions, in ceil(log2 n) rounds."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, m: StateMap) -> int:
        """The tokens of a text from the map of all of it."""
        total, word = self.apply(m, None)
        return total + self.close(word)

    def dump(self, m: StateMap) -> str:
        """A map as text that any other task can read: a state is its content, not its number."""
        tail = None if m.tail is None else [m.tail.kind, self.keys[m.tail.state], m.tail.byte]
        return json.dumps([m.kind, m.head.decode("latin-1"), m.closed, m.count, tail])

    def load(self, text: str) -> StateMap:
        kind, head, closed, count, tail = json.loads(text)
        if tail is not None:
            ending, places = tail[1]
            tail = Open(tail[0], self.state((ending, tuple((t, n) for t, n in places))), tail[2])
        return StateMap(kind, head.encode("latin-1"), closed, count, tail)


_loaded: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """The transducer of a vocabulary file, compiled once in each worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = CountTransducer(json.load(f))
    return _loaded[path]


def _long_rows(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """``(doc_id, h, n_bytes, copies, edges, before, n_tokens)`` of each distinct (id, text) of ``docs(doc_id, text)``.

    Chunks are dealt over tasks by the shuffle that joins copies; only their maps meet again by text, which are few and small.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        t = transducer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                edges = t.cuts(text, chunk)
                k = len(edges) - 1
                for a in range(0, k, 64):  # a batch holds 64 chunks at most
                    b = min(a + 64, k)
                    same = [pa.array([batch.column(c)[i].as_py()] * (b - a), batch.schema.field(c).type) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(edges[a:b], pa.int64()), pa.array([text[edges[j] : edges[j + 1]] for j in range(a, b)])], ["doc_id", "h", "n_bytes", "at", "chunk"])

    def mapped(batches):
        t = transducer(path)
        for batch in batches:
            for part in slices(batch, 5):
                t.fresh()
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([t.dump(m) for m in t.state_maps(part.column(5).to_pylist())])], [*part.schema.names[:5], "map"])

    def composed(batches):
        t = transducer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                t.fresh()
                maps = t.scan([t.load(m["map"]) for m in batch.column(4)[i].as_py()])
                # an open word is counted with what is behind it
                before = [0] + [t.apply(m, None)[0] for m in maps[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([[m["at"] for m in batch.column(4)[i].as_py()]], pa.list_(pa.int64())), pa.array([before], pa.list_(pa.int64())), pa.array([t.total(maps[-1])], pa.int64())],
                    ["doc_id", "h", "n_bytes", "copies", "edges", "before", "n_tokens"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    key = f"doc_id {kind}, h long, n_bytes long"
    dealt = rows.mapInArrow(cut, f"{key}, at long, chunk string").groupBy("doc_id", "h", "n_bytes", "at").agg(F.first("chunk").alias("chunk"), F.count("*").alias("copies"))
    maps = dealt.select("doc_id", "h", "n_bytes", "copies", "at", "chunk").mapInArrow(mapped, f"{key}, copies long, at long, map string")
    texts = maps.groupBy("doc_id", "h", "n_bytes", "copies").agg(F.sort_array(F.collect_list(F.struct("at", "map"))).alias("maps"))
    return texts.mapInArrow(composed, f"{key}, copies long, edges array<long>, before array<long>, n_tokens long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row; a null text counts as empty, an empty one has 0 tokens.

    Texts are counted by chunks of about ``chunk`` characters; those of more than ``long`` characters share their chunks with other
    tasks.  ``path`` is a vocabulary file that every worker has.  Repeated rows and null ids count each.
    """

    def run(batches):
        t = transducer(path)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(t.counts(part.column(1).to_pylist(), chunk))], ["doc_id", "n_bytes", "n_tokens"])

    rows = _texts(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    short = rows.where(F.length("text") <= long).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, schema)
    tall = _long_rows(rows.where(F.length("text") > long), path, chunk).select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return short.unionByName(tall).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_offsets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, h, at, tokens_before)``: for each chunk of each distinct text, the character it begins at and the tokens of the
    text that end in front of it (those of a word that is open there, as if it went on).  An empty text has no chunk."""
    rows = _long_rows(_texts(docs, id_col, text_col).where("text <> ''"), path, chunk)
    return rows.select("doc_id", "h", F.explode(F.arrays_zip(F.col("edges").alias("at"), F.col("before").alias("tokens_before"))).alias("x")).select("doc_id", "h", "x.at", "x.tokens_before")


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_offsets(spark, sf_dir):
    """The tokens in front of each chunk of each text."""
    import public_tokenizers

    return token_offsets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
