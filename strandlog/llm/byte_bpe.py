"""op4: byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ship
from .word_bpe import vocabulary

#: States and words that a process remembers; beyond, it forgets them all and builds what it needs anew. That changes no result.
STATES, WORDS, LONGEST = 200_000, 300_000, 64
#: The public pattern, and the same for texts of plain characters, which are of the same class everywhere.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+| ?[0-9]+| ?[!-/:-@\\[-`{-~\xd7\xf7]+|[ \n]+(?![^ \n])|[ \n]+").findall
_PLAIN = re.compile("[ \n\x21-\x7e\xc0-\u017f]*").fullmatch
#: A text of more characters isn't matched at once.
PIECE = 1 << 20
#: Bits of a start that hold the token before it; all set at the beginning. Bytes after which settled ids are given out.
BEFORE, NONE, SETTLE = 20, (1 << 20) - 1, 256
#: A text is decoded and hashed in runs of so many ids.
RUN = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], text: bytes, below: int | None = None) -> list[bytes]:
    """BPE as it is defined: again and again merge the leftmost pair whose union has the least rank (less than `below`)."""
    parts = [text[k : k + 1] for k in range(len(text))]
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            r = ranks.get(parts[k] + parts[k + 1])
            if r is not None and (below is None or r < below) and (best is None or r < best):
                best, at = r, k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """From bytes to token ids, one byte at a time.

    Compiled from the ranks: a trie of the tokens that merging can reach, and for each token the two from which its last merge
    makes it. Two tokens may follow each other if no merge across their border would come before those that made them; a
    sequence of tokens is the encoding if and only if each two neighbours may follow each other, and each prefix of a text has
    one last token [the last of its own encoding].

    A state holds the starts from which a token may still grow: for each its place in the trie and the token before it. A step
    drops starts that no token continues, and adds the position itself with the one token that may end there. Its output says
    which start each new one comes from, so a run carries for each start the tokens up to it that aren't out yet; what all
    starts agree on goes out. A token can grow no longer than the longest one in the vocabulary, so that is the lookahead
    after which its start is settled or gone. States and steps are made when first needed and remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for r in sorted(self.tokens):
            t = self.tokens[r]
            if len(t) > 1:
                parts = merged(ranks, t, r)
                if len(parts) != 2:
                    continue  # merging never makes it
                self.split[r] = pair = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[pair] = r
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][b]
            self.ends[node] = r
        self.may_follow: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.steps: dict[int, tuple] = {}  # by 256 times the state's number plus the byte
        self.start = self._number((NONE,))

    def _number(self, state: tuple[int, ...]) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = 256 * len(self.states)
            self.states.append(state)
        return n

    def _apart(self, a: int, b: int) -> bool:
        limit = 1 << 62  # a merge across the border must come before this one
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and a in self.split or b not in self.split:  # undo the later merge of the two sides
                if a not in self.split:
                    return True
                limit, a = a, self.split[a][1]
            else:
                limit, b = b + 1, self.split[b][0]

    def _step(self, state: tuple[int, ...], byte: int) -> tuple[int, tuple[int, ...] | None, int, int]:
        """The next state, which starts of this one live on (None: all), which one the new token follows, and that token."""
        children, ends, may_follow = self.children, self.ends, self.may_follow
        new, kept, after, token = [], [], -1, -1
        for k, start in enumerate(state):
            node = children[start >> BEFORE].get(byte)
            if node is None:
                continue
            if token < 0 and (end := ends[node]) >= 0:
                before = start & NONE
                if before == NONE:
                    after, token = k, end
                else:
                    pair = before << BEFORE | end
                    ok = may_follow.get(pair)
                    if ok is None:
                        if len(may_follow) >= 4 * STATES:
                            may_follow.clear()
                        ok = may_follow[pair] = self._apart(before, end)
                    if ok:
                        after, token = k, end
            if children[node]:
                new.append(node << BEFORE | start & NONE)
                kept.append(k)
        new.append(token)  # at the trie's root
        return self._number(tuple(new)), None if len(kept) == len(state) else tuple(kept), after, token

    def encode(self, word: bytes) -> Iterable[int]:
        """The ids of one match of the pattern; of a long one as soon as they are settled."""
        whole = self.ranks.get(word)
        if whole is not None:  # a match that is a token is that token
            return (whole,)
        if len(self.states) > STATES:
            self._forget()
        if len(word) > SETTLE:
            return self._long(word)
        _, paths = self._run(word, self.start, [()])
        return self._tokens(paths[-1])

    def _run(self, data: bytes, at: int, paths: list[tuple]) -> tuple[int, list[tuple]]:
        """The state and the starts' paths after these bytes. A path is a token and, before it, what it follows."""
        known = self.steps.get
        for byte in data:
            step = known(at + byte)
            if step is None:
                step = self.steps[at + byte] = self._step(self.states[at >> 8], byte)
            at, kept, after, token = step
            path = (paths[after], token)
            if kept is None:
                paths.append(path)
            else:
                paths = [paths[j] for j in kept]
                paths.append(path)
        return at, paths

    @staticmethod
    def _tokens(path: tuple) -> list[int]:
        out = []
        while path:
            path, token = path
            out.append(token)
        out.reverse()
        return out

    def _long(self, word: bytes) -> Iterator[int]:
        at, paths = self.start, [()]
        for k in range(0, len(word), SETTLE):
            if len(self.states) > STATES:
                state = self.states[at >> 8]
                self._forget()
                at = self._number(state)
            at, paths = self._run(word[k : k + SETTLE], at, paths)
            paths = yield from self._settled(paths)
        yield from self._tokens(paths[-1])

    @staticmethod
    def _settled(paths: list[tuple]) -> Iterator[int]:
        """Give out the tokens with which all paths begin; returns the paths without them."""
        flat = [Transducer._tokens(path) for path in paths]
        n = 0
        while all(len(t) > n and t[n] == flat[0][n] for t in flat):
            n += 1
        yield from flat[0][:n]
        out = []
        for tokens in flat:
            path = ()
            for token in tokens[n:]:
                path = (path, token)
            out.append(path)
        return out


class Utf8:
    """An incremental UTF-8 state machine over tokens: whole characters come out as soon as their last byte is in.

    The state is what is there of an unfinished character, three bytes at most. Bytes that can't be in well-formed UTF-8 come
    out as they are and are counted in `bad`.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.pending, self.bad = tokens, b"", 0
        self.steps: dict[bytes, dict[int, tuple[bytes, bytes, int]]] = {}
        self.partial = {i for i, t in tokens.items() if self._step(b"", t) != (b"", t, 0)}

    def _step(self, pending: bytes, data: bytes) -> tuple[bytes, bytes, int]:
        out, bad = bytearray(), 0
        for k in range(len(data)):
            pending += data[k : k + 1]
            while pending:
                need = self.needed(pending)
                if need > 0:
                    break
                if need == 0:
                    out += pending
                    pending = b""
                else:  # its first byte can't begin or go on
                    out += pending[:1]
                    pending, bad = pending[1:], bad + 1
        return pending, bytes(out), bad

    @staticmethod
    def needed(c: bytes) -> int:
        """Bytes that an unfinished character lacks; 0: none; -1: no character begins so."""
        a = c[0]
        if a < 0x80:
            return 0
        n = 2 if 0xC2 <= a < 0xE0 else 3 if 0xE0 <= a < 0xF0 else 4 if 0xF0 <= a < 0xF5 else 0
        if not n:
            return -1
        if len(c) > 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(a, (0x80, 0xBF))
            if not low <= c[1] <= high or any(not 0x80 <= x <= 0xBF for x in c[2:]):
                return -1
        return n - len(c)

    def feed(self, ids: list[int]) -> bytes:
        """The characters that these tokens complete, in UTF-8."""
        if not self.pending and self.partial.isdisjoint(ids):  # the state stays as it is
            return b"".join(map(self.tokens.__getitem__, ids))
        steps, pending, out = self.steps, self.pending, []
        own = steps.setdefault(pending, {})
        for i in ids:
            step = own.get(i)
            if step is None:
                step = own[i] = self._step(pending, self.tokens[i])
            out.append(step[1])
            if step[0] is not pending:
                pending = step[0]
                own = steps.setdefault(pending, {})
            if step[2]:
                self.bad += step[2]
        self.pending = pending
        return b"".join(out)

    def close(self) -> bytes:
        """What is left of an unfinished character."""
        rest, self.pending = self.pending, b""
        self.bad += len(rest)
        return rest


class Codec:
    """Encoding and decoding of whole texts. Words met before aren't run through the transducer again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(read_ranks(path))
        self.words: dict[str, tuple[int, ...]] = {}
        self.decoder = Utf8(self.transducer.tokens)
        self.decimal = {i: str(i) for i in self.transducer.tokens}
        self.plain = pattern == PATTERN

    def encode(self, text: str) -> Iterator[Iterable[int]]:
        """The ids of each match of the pattern, in order. A long text is matched bit by bit."""
        if len(text) > PIECE:
            words = (m.group() for m in self.pattern.finditer(text))
        else:
            words = _PIECES(text) if self.plain and _PLAIN(text) else self.pattern.findall(text)
        known = self.words
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self.transducer.encode(word.encode())
                if len(word) <= LONGEST:
                    if len(known) >= WORDS:
                        known.clear()
                    ids = known[word] = tuple(ids)
            yield ids

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of what they decode to; a run of ids at a time."""
        from hashlib import sha256
        from itertools import chain, islice

        listed, decoded, n = sha256(), sha256(), 0
        ids = chain.from_iterable(self.encode(text))
        while run := list(islice(ids, RUN)):
            listed.update(((b"," if n else b"") + ",".join(map(self.decimal.__getitem__, run)).encode()))
            decoded.update(self.decoder.feed(run))
            n += len(run)
        decoded.update(self.decoder.close())
        return n, listed.hexdigest(), decoded.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The process's codec for this file and pattern; the public multilingual ranks unless given."""
    import public_tokenizers

    key = (path or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for doc_id, t in zip(b.column(0), b.column(1).to_pylist()):
                yield pa.record_batch([pa.array([doc_id.as_py()], pa.int64()), pa.array([[i for w in own.encode(t or "") for i in w]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of rows (doc_id, ids array<int>). Bytes that aren't UTF-8 become U+FFFD."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern).decoder
        for b in batches:
            texts = [(own.feed(i or []) + own.close()).decode(errors="replace") for i in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def roundtrip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text; further columns don't matter).

    A null or empty text has no ids and the digests of nothing. Rows are independent: repeated ones are returned each, an
    empty table gives none. A long text is encoded, hashed and decoded in runs of ids.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            n, listed, text = zip(*(own.digests(t or "") for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(documents(spark, sf_dir))
