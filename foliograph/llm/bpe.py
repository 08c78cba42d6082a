"""Operator 6: byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if each token, and each pair of neighbours, is the encoding of
its own bytes: a merge across a boundary is the cheapest in the whole text only if it is so in the pair. So a transducer
may guess tokens as it reads: its states are places in the trie of tokens along with the token before, and it steps from
the end of one token to the start of another if they may be neighbours. Every prefix has one encoding, so just one guess
ends at each byte.

The transducer is made deterministic as it goes: a state is the set of all guesses still alive, each a place in the trie
and the token before it. A transition gives the next state and the token that ends there; tokens that all guesses alive
have in common are final and are emitted, at the end of a piece or after a bounded lookahead. Transitions are worked out
when first taken and kept.

Decoding is a stream: an incremental UTF-8 state machine, lifted from bytes to tokens, passes on whole characters only,
however tokens and chunks cut them, and tells ids that are no text.

Defined results: null counts as the empty text, which has no ids; rows are encoded one by one, so repeated rows and order
do not matter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import computed
from .tokens import Encoder

#: States and pairs that a worker keeps; only memory depends on them.
STATES, PAIRS = 250_000, 800_000

#: Bytes of a piece that are read before what is final of it is emitted.
LOOKAHEAD = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Encodes single pieces, as the splitting pattern gives them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._sizes = {rank: len(token) for token, rank in ranks.items()}
        self._trie: dict[int, int] = {}
        self._token_at, self._goes_on, self._depth = [-1], [False], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self._trie:
                    self._trie[key] = len(self._token_at)
                    self._token_at.append(-1)
                    self._goes_on.append(False)
                    self._depth.append(self._depth[node] + 1)
                    self._goes_on[node] = True
                node = self._trie[key]
            self._token_at[node] = rank
        self._pairs: dict[int, bool] = {}
        self._halved: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self._number, self._states, self._next = {}, [], []
        self._state((0,))

    def _state(self, guesses: tuple) -> int:
        if guesses not in self._number:
            self._number[guesses] = len(self._states)
            self._states.append(guesses)
            self._next.append({})
        return self._number[guesses]

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """The encoding by the merges themselves: again and again the pair of the least rank, the first of equals.

        ``below``: only by merges of lesser rank.
        """
        parts, none = [data[i : i + 1] for i in range(len(data))], len(self.ranks) << 1
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= (none if below is None else below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a byte, and for a token that its bytes don't encode to."""
        if token not in self._halved:
            data, found = self.tokens[token], None
            if len(data) > 1:
                parts = self.merged(data, token)
                if len(parts) == 2:
                    found = parts[0], parts[1]
            self._halved[token] = found
        return self._halved[token]

    def _stands(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return len(self.tokens[token]) == 1 or self._halves(token) is not None

    def _may_follow(self, before: int, token: int) -> bool:
        """``before`` is -1 at the start of a piece."""
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        found = self._pairs[before << 20 | token] = self._stands(token) and (before < 0 or self._no_merge_crosses(before, token))
        return found

    def _no_merge_crosses(self, a: int, b: int) -> bool:
        """Whether two tokens that stand by themselves stand side by side.

        Their merges are undone, the last first. At each point the tokens that meet at the boundary must not merge into
        one that would have come before the merge just undone: to the left of it, ties go to the boundary's merge, to the
        right of it they don't.
        """
        ranks, tokens, limit = self.ranks, self.tokens, len(self.ranks) << 1
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            left, right = self._halves(a), self._halves(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the token that ends with it; kept for the next time.

        A guess is packed in one number: its place in the trie, and the token before it plus one, zero for none.
        """
        trie, token_at, goes_on, pairs = self._trie.get, self._token_at, self._goes_on, self._pairs.get
        alive, ended = [], -1
        for guess in self._states[state]:
            child = trie((guess >> 20) << 8 | byte)
            if child is None:
                continue
            if ended < 0 and (token := token_at[child]) >= 0:
                before = (guess & 0xFFFFF) - 1
                may = pairs(before << 20 | token)
                if may or may is None and self._may_follow(before, token):
                    ended = token
            if goes_on[child]:
                alive.append(child << 20 | guess & 0xFFFFF)
        if ended < 0:
            raise ValueError(f"no token for byte {byte}")
        alive.append(ended + 1)
        to = self._next[state][byte] = self._state(tuple(alive)), ended
        return to

    def _chain(self, ended: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the last back to the first."""
        out, sizes = [], self._sizes
        while at > 0:
            token = ended[at - 1]
            out.append(token)
            at -= sizes[token]
        return out

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self._states) > STATES:
            self._forget()
        out, ended, state, following, mark = [], [], 0, self._next, LOOKAHEAD
        for byte in piece:
            state, token = following[state].get(byte) or self._step(state, byte)
            ended.append(token)
            if len(ended) >= mark:
                out += self._agreed(ended, state)
                mark = max(LOOKAHEAD, 2 * len(ended))  # where nothing was final, look again after as much once more
        tail = self._chain(ended, len(ended))
        tail.reverse()
        return out + tail

    def _agreed(self, ended: list[int], state: int) -> list[int]:
        """The tokens that all guesses alive have in common; they are final, and taken off ``ended``."""
        common = None
        for guess in self._states[state]:
            at = begin = len(ended) - self._depth[guess >> 20]
            ends = {begin}
            for token in self._chain(ended, begin):
                at -= self._sizes[token]
                ends.add(at)
            common = ends if common is None else common & ends
        cut = max(common)
        final = self._chain(ended, cut)
        final.reverse()
        del ended[:cut]
        return final


class Codec(Encoder):
    """Encodes whole texts to ids: split by the pattern, each piece through the transducer."""

    kept = 1_500_000

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self._split = regex.compile(pattern).findall
        self.decimals = {i: str(i) for i in self.transducer.tokens}
        self._known = {}
        self._marks = {x: self._raw([x])[0] for x in ".,"}

    def _raw(self, texts: list[str]) -> list[bytes]:
        encode = self.transducer.encode
        return [array("I", [i for p in self._split(t) for i in encode(p.encode())]).tobytes() for t in texts]

    def _together(self, found: list[str]) -> list[bytes]:
        """One by one: the transducer gains nothing from longer texts, and other patterns may cut them elsewhere."""
        return self._raw([" " + x for x in found])

    def _word(self, letters: str) -> bytes:
        return array("I", self.transducer.encode(b" " + letters.encode())).tobytes()


#: States of the UTF-8 machine: what the next byte may be, and the state after it. 0 is between characters.
_ANY, _START, _BAD = (0x80, 0xBF), 0, -1
_AFTER = {1: (_ANY, 0), 2: (_ANY, 1), 3: (_ANY, 2), 4: ((0xA0, 0xBF), 1), 5: ((0x80, 0x9F), 1), 6: ((0x90, 0xBF), 2), 7: ((0x80, 0x8F), 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == _START:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return _BAD
    (low, high), to = _AFTER[state]
    return to if low <= byte <= high else _BAD


class StreamDecoder:
    """Turns ids, chunk by chunk, into the UTF-8 bytes of whole characters."""

    def __init__(self, tokens: dict[int, bytes], lifted: list[dict[int, int]] | None = None):
        self._tokens, self._state, self._held = tokens, _START, b""
        self._lifted = lifted if lifted is not None else [{} for _ in range(8)]

    def _lift(self, state: int, token: int) -> int:
        to = state
        for byte in self._tokens[token]:
            to = utf8_step(to, byte)
            if to == _BAD:
                raise ValueError("these ids are no UTF-8 text")
        self._lifted[state][token] = to
        return to

    def feed(self, ids: Iterable[int]) -> bytes:
        state, lifted, tokens = self._state, self._lifted, self._tokens
        for i in ids:
            to = lifted[state].get(i)
            state = self._lift(state, i) if to is None else to
        data = self._held + b"".join([tokens[i] for i in ids])
        self._state = state
        cut = len(data)
        if state != _START:  # the last lead byte begins the unfinished character
            cut = next(k for k in range(len(data) - 1, -1, -1) if data[k] >= 0xC0)
        self._held = data[cut:]
        return data[:cut]

    def finish(self) -> None:
        if self._state != _START:
            raise ValueError("the ids end within a character")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return computed(rows, ["doc_id"], [T.StructField("ids", T.BinaryType())], lambda texts: [pa.array(codec(ranks, pattern).encode(texts), pa.binary())])


def decode(encoded: DataFrame, ranks: str, pattern: str, chunk: int = 4096) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        tokens, lifted = codec(ranks, pattern).transducer.tokens, [{} for _ in range(8)]
        for batch in batches:
            texts = [b"".join(_stream(tokens, lifted, i or b"", chunk)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _stream(tokens: dict, lifted: list, ids: bytes, chunk: int) -> Iterable[bytes]:
    decoder, numbers = StreamDecoder(tokens, lifted), memoryview(ids).cast("I")
    for at in range(0, len(numbers), chunk):
        yield decoder.feed(numbers[at : at + chunk])
    decoder.finish()


def digests(docs: DataFrame, ranks: str, pattern: str, chunk: int = 4096) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text): encoded, and the ids decoded as a stream."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    lifted: list[dict[int, int]] = [{} for _ in range(8)]

    def compute(texts):
        own = codec(ranks, pattern)
        tokens, written = own.transducer.tokens, own.decimals
        sizes, sums, decoded = [], [], []
        for ids in own.encode(texts):
            numbers = memoryview(ids).cast("I")
            sizes.append(len(numbers))
            sums.append(hashlib.sha256(",".join([written[i] for i in numbers]).encode()).hexdigest())
            total = hashlib.sha256()
            for part in _stream(tokens, lifted, ids, chunk):
                total.update(part)
            decoded.append(total.hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return computed(rows, ["doc_id"], fields, compute)
