"""Operator 5, byte-pair encoding and decoding as streaming transducers.

Encoding. `Merges` holds a merge list as ranks of byte strings. Two tokens are compatible
if encoding their concatenation gives the two back; a sequence is the encoding of its text
exactly if all neighbours are compatible. So the last token of the encoding of a prefix is
the one suffix of it that is a token and compatible with the last token before it, and the
encoding of a longer text is one of the last positions' own. How far a later byte can reach
back is bounded by the merge list: `lookahead` follows, in order of rank, the chains of merges
that can take a piece away from the one to their left, and gives the greatest span in bytes.
`Encoder` emits every token that ends so many bytes before the last one read, and keeps only
the positions since: its memory is constant however long the text.

Before merging, a text is cut into pieces by the vocabulary's pattern; merges never cross
a cut, so a piece's encoding is a function of the piece and is remembered, up to a limit,
in each worker. Cuts are found on arrays of character classes, not by a regex engine. Texts
of up to `SLICE_BYTES` are cut together; a longer one is fed in chunks of `CHUNK_BYTES` to
`TextEncoder`, which holds back what the next bytes can still change: the last piece, or of
a piece longer than `HOLD` characters only what its `Encoder` holds.

Decoding. `Decoder` maps ids to bytes and bytes to text with a UTF-8 state machine that
holds back an unfinished character at the end of a chunk and replaces malformed bytes as
Python does. `round_trip` compares what it returns for a document's ids with the text.

Defined results: a null text has null tokens; an empty one has none; equal texts have
equal tokens; an unknown id raises. Valid text comes back character for character. Bytes
that are no UTF-8 count as signs, one each, and are encoded as they are; `round_trip` then
compares texts in which both sides replace them.
"""
from __future__ import annotations

import base64
import codecs
import heapq
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import map_texts, slices, text_buffers

RESULT = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"
SLICE_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20
HOLD = 4_096  # characters of an unfinished piece that are held before it is streamed
SETTLED = 4  # so many characters from the end, cuts can't change any more
REMEMBERED = 500_000  # pieces per worker
SHORT_PIECE = 24  # bytes; up to so many are read at once
LONG_PIECE = 64  # longer pieces are streamed and not remembered


class Merges:
    """A merge list: token bytes by rank, with what is needed to tell stable tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.longest = max(map(len, ranks))
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and (parts := self._halves(t, r)):
                self.split[r] = parts
                self.pair[parts] = r
        self.compatible: dict[tuple[int, int], bool] = {}
        # the lengths of the tokens that end in given three bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.by_end = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.ahead = self.lookahead()

    def _halves(self, t: bytes, r: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t: what merging t with lower ranks only leaves."""
        parts = [self.ranks[t[i: i + 1]] for i in range(len(t))]
        while len(parts) > 2:
            best, at = r, -1
            for i in range(len(parts) - 1):
                m = self.pair.get((parts[i], parts[i + 1]), r)
                if m < best:
                    best, at = m, i
            if at < 0:
                return None
            parts[at: at + 2] = [best]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def lookahead(self) -> int:
        """Bytes after a token's start that can still decide about it, at most.

        reach[t]: the span from t's start over which a chain of earlier merges can still
        take a right part of t away; taken[t]: the widest chain that begins with merging t
        to its right neighbour. Merges go in order of rank, so a chain only meets ranks
        below its own.
        """
        size = [len(t) for t in self.tokens]
        reach, taken, widest = {}, {}, self.longest
        for r in sorted(self.split):
            left, right = self.split[r]
            span = size[left] + max(size[right], taken.get(right, 0), reach.get(right, 0))
            reach[r] = span
            taken[left] = max(taken.get(left, 0), span)
            widest = max(widest, span)
        return widest

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the lowest rank first, leftmost of equals."""
        parts = [self.ranks[data[i: i + 1]] for i in range(len(data))]
        pair = self.pair
        while len(parts) > 1:
            best, at = sys.maxsize, -1
            for i in range(len(parts) - 1):
                m = pair.get((parts[i], parts[i + 1]), sys.maxsize)
                if m < best:
                    best, at = m, i
            if at < 0:
                break
            parts[at: at + 2] = [best]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when encoded together.

        Undoes both tokens' merges along the boundary from the highest rank down: they fit
        unless a merge across it comes before the one that hides its operands.
        """
        known = self.compatible.get((a, b))
        if known is None:
            known = self._fits(a, b)
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[a, b] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit = sys.maxsize
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            left, right = self.split.get(a), self.split.get(b)
            if left is None and right is None:
                return True
            # undo the later merge; of equal ones the left is made first, so the right goes
            if left is not None and (right is None or a > b):
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]


    def whole(self, data: bytes) -> tuple[int, ...]:
        """What `Encoder` gives for a short piece that is there at once: compatible tokens from front to back.

        At each place the longest compatible token is tried first. A way to a position is the
        only one, so a position from which none leads on is never reached again.
        """
        ranks, compatible, fits, n = self.ranks, self.compatible, self.fits, len(data)
        out, at, size, dead = [], 0, n, set()
        before = -1
        while at < n:
            while size:
                t = ranks.get(data[at: at + size])
                if t is not None and (not dead or at + size not in dead):
                    if before < 0:
                        break
                    ok = compatible.get((before, t))
                    if fits(before, t) if ok is None else ok:
                        break
                size -= 1
            if size:
                out.append(t)
                at, before = at + size, t
                size = n - at
            else:  # the last token leads nowhere: a shorter one in its place
                dead.add(at)
                size = len(self.tokens[out.pop()]) - 1
                at -= size + 1
                before = out[-1] if out else -1
        return tuple(out)


class Encoder:
    """Feeds on bytes of one piece; returns tokens as soon as nothing to come can change them."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.tail = b""  # bytes since the last final token
        self.last: list[tuple[int, int]] = []  # for each of them the last token and where it starts
        self.first = -1  # the final token before the tail
        self.held = 0  # most bytes ever held

    def feed(self, data: bytes) -> list[int]:
        out, most = [], self.m.ahead + self.m.longest
        while data:
            take = most - len(self.tail)
            self._advance(data[:take])
            data = data[take:]
            if len(self.tail) >= most:
                out += self._settle()
        return out

    def _advance(self, data: bytes) -> None:
        m, last, first = self.m, self.last, self.first
        ranks, by_end, fits = m.ranks, m.by_end, m.fits
        tail = self.tail + data
        for n in range(len(self.tail) + 1, len(tail) + 1):
            if n > 2:
                for size in by_end.get(tail[n - 3: n], ()):
                    at = n - size
                    if at >= 0 and (token := ranks.get(tail[at: n])) is not None:
                        before = last[at - 1][0] if at else first
                        if before < 0 or fits(before, token):
                            last.append((token, at))
                            break
                else:
                    self._short(tail, n)
            else:
                self._short(tail, n)
        self.tail = tail

    def _short(self, tail: bytes, n: int) -> None:
        """A token of two bytes if it fits, else one of one byte."""
        at = n - 2
        if at >= 0 and (token := self.m.ranks.get(tail[at: n])) is not None:
            before = self.last[at - 1][0] if at else self.first
            if before < 0 or self.m.fits(before, token):
                self.last.append((token, at))
                return
        self.last.append((self.m.ranks[tail[n - 1: n]], n - 1))

    def _settle(self) -> list[int]:
        """Final tokens: those that end at least the lookahead before the last byte."""
        self.held = max(self.held, len(self.tail))
        cut, final = len(self.tail), len(self.tail) - self.m.ahead
        while cut > final:
            cut = self.last[cut - 1][1]
        return self._emit(cut) if cut else []

    def _emit(self, cut: int) -> list[int]:
        out, at = [], cut
        while at > 0:
            token, at = self.last[at - 1]
            out.append(token)
        out.reverse()
        self.first = out[-1]
        self.tail = self.tail[cut:]
        self.last = [(t, s - cut) for t, s in self.last[cut:]]
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.tail)) if self.tail else []
        self.first = -1
        return out


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 4 other, for every code point."""
    out = np.full(0x110000, 4, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[c] = 3
    return out


ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def cuts(codes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where pieces start, for texts laid end to end (code points; stops: their ends).

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ sLN]+|s+(?!S)|s+ .
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[codes]
    begins = np.zeros(n + 1, bool)
    begins[stops[stops < n]] = True
    begins[0] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    ends = np.append(begins[1:n], True)  # the last character of its text
    space = kind == 3
    after = np.append(~space[1:], False) & ~ends
    # the last blank before a visible character: a plain space joins it, another stands alone
    lone = space & after
    start |= lone
    joined = np.flatnonzero(lone & (codes == 32)) + 1
    start[joined] = False
    # contractions: only at a place where a piece can begin with the apostrophe
    for i in np.flatnonzero((codes == 39) & start).tolist():
        word = codes[i: i + 3].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
        stop = int(np.searchsorted(stops, i, side="right"))
        word = word[: int(stops[stop]) - i]
        got = next((e for e in ENDINGS if word.startswith(e)), None)
        if got:
            start[i] = True
            start[i + 1: i + len(got)] = False
            if i + len(got) < n:
                start[i + len(got)] = True
                # what follows begins anew; a space taken as the next word's stays with it
    return np.flatnonzero(start)


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Codec:
    """Pieces and the memory of their encodings, over one merge list."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> tuple[int, ...]:
        got = self.memo.get(data)
        if got is None:
            rank = self.m.ranks.get(data)
            if rank is not None:
                got = (rank,)
            elif len(data) <= SHORT_PIECE:
                got = self.m.whole(data)
            else:
                e = Encoder(self.m)
                got = tuple(e.feed(data) + e.finish())
            if len(data) <= LONG_PIECE:
                if len(self.memo) >= REMEMBERED:
                    self.memo.clear()
                self.memo[data] = got
        return got

    def join(self, whole: bytes, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's begin) of the pieces between bounds."""
        memo, one = self.memo, self.piece
        found = [memo.get(p) or one(p) for p in map(whole.__getitem__, map(slice, bounds, bounds[1:]))]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))

    def encode(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, where each text's begin) for texts laid end to end."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        whole = raw.tobytes()
        lead = (raw & 0xC0) != 0x80  # where characters begin
        try:
            codes = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
            alone = lead[offsets[:-1][offsets[:-1] < len(raw)]].all()  # no character over two texts
        except UnicodeDecodeError:
            alone = False
        if not alone:
            each = [self.stream(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        lead = np.flatnonzero(lead)
        stops = np.searchsorted(lead, offsets[1:])
        at = np.append(lead[cuts(codes, stops)], len(raw))
        ids, ends = self.join(whole, at.tolist())
        return ids, ends[np.searchsorted(at[:-1], offsets)]

    def stream(self, data: bytes | memoryview) -> np.ndarray:
        """The ids of one text, fed in chunks."""
        e = TextEncoder(self)
        return np.concatenate([e.feed(bytes(data[i: i + CHUNK_BYTES])) for i in range(0, len(data), CHUNK_BYTES)] + [e.finish()])


class TextEncoder:
    """Feeds on the bytes of a text; returns the ids of what nothing to come can change."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.state = codecs.getincrementaldecoder("utf-8")("surrogateescape")  # a malformed byte is one character
        self.text = ""
        self.piece: Encoder | None = None  # of a piece that began before the text held
        self.known = 0  # characters at the front of the text that this encoder already has
        self.held = 0  # most characters ever held

    def feed(self, data: bytes, final: bool = False) -> np.ndarray:
        self.text += self.state.decode(data, final)
        text, out = self.text, []
        n = len(text)
        self.held = max(self.held, n)
        if not final and n - self.known <= SETTLED:
            return np.zeros(0, np.int32)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = cuts(codes, np.array([n]))
        at = at[at >= self.known] if final else at[(at >= self.known) & (at <= n - SETTLED)]
        if self.piece is not None:
            ended = final or len(at) > 0
            stop = int(at[0]) if len(at) else n if final else n - SETTLED
            out.append(np.array(self.piece.feed(self._bytes(text[self.known: stop])) + (self.piece.finish() if ended else []), np.int32))
            if not ended:
                self._keep(stop)
                return out[0]
            self.piece = None
        if final:
            at = np.append(at, n)
        if len(at) > 1:
            a, b = int(at[0]), int(at[-1])
            size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
            size[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
            place = np.concatenate(([0], np.cumsum(size[a:b])))
            out.append(self.codec.join(self._bytes(text[a:b]), place[at - a].tolist())[0])
        start = int(at[-1]) if len(at) else n
        self.text, self.known = text[start:], 0
        if not final and len(self.text) > HOLD:
            self.piece = Encoder(self.codec.m)
            stop = len(self.text) - SETTLED
            out.append(np.array(self.piece.feed(self._bytes(self.text[:stop])), np.int32))
            self._keep(stop)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _keep(self, stop: int) -> None:
        """Of the text before stop, all in one piece, only what cuts look back at."""
        first = max(0, stop - SETTLED)
        self.text, self.known = self.text[first:], stop - first

    @staticmethod
    def _bytes(text: str) -> bytes:
        return text.encode("utf-8", "surrogateescape")

    def finish(self) -> np.ndarray:
        return self.feed(b"", True)


class Decoder:
    """Ids in chunks to text; an unfinished character waits for the next chunk."""

    def __init__(self, merges: Merges):
        self.tokens = merges.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def same_text(decoder: Decoder, ids: np.ndarray, data: memoryview) -> bool:
    """Whether ids decode to the text of data; both are read in chunks."""
    source, found, wanted, i, j = codecs.getincrementaldecoder("utf-8")("replace"), "", "", 0, 0
    while True:
        more = not (i >= len(ids) and j >= len(data))
        if more:
            found += decoder.feed(ids[i: i + CHUNK_BYTES // 4].tolist())
            wanted += source.decode(data[j: j + CHUNK_BYTES])
            i, j = i + CHUNK_BYTES // 4, j + CHUNK_BYTES
        else:
            return found + decoder.finish() == wanted + source.decode(b"", True)
        n = min(len(found), len(wanted))
        if found[:n] != wanted[:n]:
            decoder.finish()
            return False
        found, wanted = found[n:], wanted[n:]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(load_merges(path))


def encode_documents(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, n_tokens, tokens, and whether decoding them gives the text back."""

    def run(batches):
        c = codec(vocabulary)
        decoder = Decoder(c.m)
        for b in batches:
            off, raw = text_buffers(b.column(1))
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(off, SLICE_BYTES):
                o, r = off[i: j + 1] - off[i], raw[off[i]: off[j]]
                if len(r) > SLICE_BYTES:  # one long text
                    ids = c.stream(memoryview(r))
                    first = np.array([0, len(ids)])
                else:
                    ids, first = c.encode(o, r)
                data = memoryview(r)
                good = [same_text(decoder, ids[a:z], data[x:y]) for a, z, x, y in zip(first[:-1].tolist(), first[1:].tolist(), o[:-1].tolist(), o[1:].tolist())]
                mask = null[i:j]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=pa.array(mask))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int32), mask=mask), lists, pa.array(good, pa.bool_(), mask=mask)], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, RESULT)
