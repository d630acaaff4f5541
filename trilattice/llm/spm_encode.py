"""SentencePiece encoding and decoding with a forward pass shared between words of a common prefix.

A text is cut into marked words, runs of spaces with what follows up to the next space, which no piece crosses. The
distinct marked words of a batch are sorted, which lays them out as a trie read depth-first: from one word to the next the
forward states of the common prefix stay on the stack, and only the new characters are computed.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). A BPE model gives no sum of
scores to maximise: the best-scoring path is not what merging in order of rank makes. Its state is the last piece of the
prefix's encoding, which is the one piece t ending there such that t may stand after the last piece of the prefix
before it; whether two pieces may stand side by side follows from undoing their merges. Both passes are linear in the
word, and both equal the library's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trilattice.llm.common import fresh, mapped, quoted, slices, table

#: Types of pieces in the model file, and its mark for a space. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MARK = "▁"
#: Words in each of a worker's two generations, and pairs of pieces that it knows. Both are bounded by an executor's memory.
MEMO, BESIDE = 120_000, 400_000
#: Characters that are cut into words and encoded together, and beyond which a text is taken in parts.
GROUP, PART = 1 << 21, 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file of either sort."""

    def __init__(self, data: bytes):
        self.pieces, self.kinds, scores = [], [], []
        self.bpe, self.dummy_prefix, squeeze, rules = False, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                if own.get(3, 1) not in (1, 2):
                    raise ValueError("neither a unigram nor a BPE model")
                self.bpe = own.get(3, 1) == 2
            elif field == 3:
                own = dict(_fields(value))
                rules, self.dummy_prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if rules or squeeze or USER in self.kinds:
            raise ValueError("only models with identity normalisation, kept spaces and no user-defined pieces are read")
        # within this module a space stands for the mark
        self.vocabulary = {p.replace(MARK, " "): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, UNUSED)}
        self.scores = scores
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.vocabulary))
        joined = set("".join(p for p in self.vocabulary if len(p) > 1))
        if any(" " in p.lstrip(" ") for p in self.vocabulary):
            raise ValueError("a piece goes past the end of a word")
        apart = "" if "\n" in joined else "\n"
        self.words = re.compile(rf"{apart}| *[^ {apart}]+| +" if apart else r" *[^ ]+| +").findall
        self.border = re.compile("[^ ] ").search
        self.texts = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.forward = BpeForward(self) if self.bpe else UnigramForward(self)

    def _bytes_of(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def ids_of(self, pieces: Iterable[str]) -> tuple[int, ...]:
        """Ids of a word's pieces; a character without a piece becomes its bytes, or the unknown piece."""
        out: list[int] = []
        for p in pieces:
            i = self.vocabulary.get(p)
            if i is not None:
                out.append(i)
            elif min(self.bytes) >= 0:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def parts(self, text: str) -> Iterator[str]:
        """The normal form of a text, cut before a space that begins a word where a part reaches PART characters."""
        text = (" " if self.dummy_prefix else "") + text.replace(MARK, " ") if text else ""
        at = 0
        while len(text) - at > PART:
            border = self.border(text, at + PART)
            if border is None:
                break
            yield text[at : border.start() + 1]
            at = border.start() + 1
        yield text[at:]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their bytes, without the space put in front."""
        out = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


class BpeForward:
    """Forward states of a BPE model: the last piece of the encoding of each prefix."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, model.vocabulary
        # pieces as numbers: their ids, and numbers above all ids for characters that are no piece
        self.number = dict(model.vocabulary)
        self.names = [p.replace(MARK, " ") for p in model.pieces]
        # by the last three characters, the lengths above one that a piece may have, the longest first, each with the piece where three characters tell it
        found: dict[str, set[int]] = {}
        for p in model.vocabulary:
            if len(p) > 2:
                found.setdefault(p[-3:], set()).add(len(p))
        self.options: dict[str, tuple[tuple[int, int | None], ...]] = {}
        for end, sizes in found.items():
            sure = [(n, self.number[end[-n:]]) for n in (3, 2) if end[-n:] in self.number]
            self.options[end] = (*((n, None) for n in sorted(sizes - {3}, reverse=True)), *sure)
        # merges of lower rank come first; single characters are never merged into
        self.rank = {p: -model.scores[i] if len(p) > 1 else -1.0 for p, i in model.vocabulary.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.beside: dict[int, bool] = {}

    def merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The encoding by merging itself, the best rank and then the leftmost pair first; and the halves of the last merge."""
        symbols: list[str] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        queue: list[tuple[float, int, int, str, str]] = []
        last = None

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(word) and (symbols[i] + symbols[j]) in self.vocabulary:
                heapq.heappush(queue, (self.rank[symbols[i] + symbols[j]], i, j, symbols[i], symbols[j]))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i], symbols[j], last = a + b, "", (a, b)
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s], last

    def split(self, piece: str) -> tuple[str, str] | None:
        """What the last merge of a piece joined; None for one character."""
        if piece not in self.halves:
            self.halves[piece] = self.merge(piece)[1] if len(piece) > 1 else None
        return self.halves[piece]

    def numbered(self, character: str) -> int:
        """The number of one character, given at its first use if it is no piece."""
        if character not in self.number:
            self.number[character] = len(self.names)
            self.names.append(character)
        return self.number[character]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging a + b ends in these two pieces: no merge over their border comes before those within them.

        Undoes the merges next to the border, the last one first. Of merges of one rank the leftmost comes first, so a
        merge over the border is too late against one in a of the same rank and in time against one in b."""
        bound, same = float("inf"), True
        while True:
            over = self.rank.get(a + b)
            if over is not None and (over < bound or same and over == bound):
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and self.rank[a] > self.rank[b]:
                bound, same, a = self.rank[a], False, left[1]
            else:
                bound, same, b = self.rank[b], True, right[0]

    def run(self, words: list[str]) -> Iterator[Iterable[int]]:
        """Ids of each of the sorted words.

        Of the pieces that end a prefix the longest that may stand there is its state; where none of two characters or
        more may, it is the last character, as every prefix has an encoding.
        """
        names, beside, ending, get, base = self.names, self.beside, self.options.get, self.number.get, len(self.model.pieces)
        ends: list[int] = [0]
        sizes: list[int] = [0]
        before = ""
        for word in words:
            if word.startswith("  "):
                # pieces of spaces share one score, so that their order is no rank
                yield self.model.ids_of(self.merge(word)[0])
                continue
            same = _common(before, word)
            del ends[same + 1 :], sizes[same + 1 :]
            before = word
            for i in range(same + 1, len(word) + 1):
                options = ending(word[i - 3 : i]) if i > 2 else None
                if options is None:
                    options = ((2, get(word[i - 2 : i])),) if i > 1 else ()
                for n, piece in options:
                    j = i - n
                    if piece is None and (j < 0 or (piece := get(word[j:i])) is None):
                        continue
                    if j:
                        key = ends[j] << 32 | piece
                        fits = beside.get(key)
                        if fits is None:
                            if len(beside) > BESIDE:
                                beside.clear()
                            fits = beside[key] = self.may_follow(names[ends[j]], names[piece])
                        if not fits:
                            continue
                    break
                else:
                    n, piece = 1, get(word[i - 1])
                    if piece is None:
                        piece = self.numbered(word[i - 1])
                ends.append(piece)
                sizes.append(n)
            out, i = [], len(word)
            while i:
                out.append(ends[i])
                i -= sizes[i]
            out.reverse()
            yield out if max(out) < base else self.model.ids_of(map(names.__getitem__, out))


class UnigramForward:
    """Forward states of a unigram model: best score and last piece of each prefix."""

    def __init__(self, model: Model):
        self.model = model
        self.scores = {p: model.scores[i] for p, i in model.vocabulary.items() if model.kinds[i] == NORMAL}
        self.longest = model.longest
        self.unknown = min(self.scores.values()) - 10.0

    def run(self, words: list[str]) -> Iterator[Iterable[int]]:
        """Ids of each of the sorted words."""
        best, ends, before = [0.0], [""], ""
        for word in words:
            same = _common(before, word)
            del best[same + 1 :], ends[same + 1 :]
            before = word
            for i in range(same + 1, len(word) + 1):
                top, last = best[i - 1] + self.scores.get(word[i - 1], self.unknown), word[i - 1]
                for j in range(i - 2, max(0, i - self.longest) - 1, -1):
                    score = self.scores.get(word[j:i])
                    if score is not None and best[j] + score > top:
                        top, last = best[j] + score, word[j:i]
                best.append(top)
                ends.append(last)
            out, i = [], len(word)
            while i:
                out.append(ends[i])
                i -= len(ends[i])
            yield self.model.ids_of(out[::-1])


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


class Encoder:
    """Encodes batches of texts. Between batches it keeps the words of late, in two generations of about `memo`."""

    def __init__(self, model: Model, memo: int = MEMO):
        self.model, self.memo, self.known, self.older = model, memo, {}, {}

    def encode(self, texts: list[str]) -> list[array]:
        """The ids of each text. Words of one group of parts are sorted together; no more than that is held as words."""
        out = [array("i") for _ in texts]
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in self.model.parts(text):
                owners.append(i)
                parts.append(part)
                size += len(part)
                if size >= GROUP:
                    self._group(owners, parts, out)
                    owners, parts, size = [], [], 0
        self._group(owners, parts, out)
        return out

    def _group(self, owners: list[int], parts: list[str], out: list[array]) -> None:
        # parts are cut twice, as the words of all of them would be the largest thing held
        found: set[str] = set()
        for part in parts:
            found.update(self.model.words(part))
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in found:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        new.sort()
        for w, ids in zip(new, self.model.forward.run(new)):
            known[w] = array("i", ids).tobytes()
        for i, part in zip(owners, parts):
            out[i].frombytes(b"".join([known[w] for w in self.model.words(part)]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a model file, kept by the worker."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(Model(f.read()))
    return _ENCODERS[path]


#: Columns that encoded() adds, and those it derives from them.
ADDED, DIGESTS = ["ids", "decoded"], ["n_ids", "ids_md5", "round_trip"]


def encoded(docs: DataFrame, path: str, text: str = "text", digests: bool = False, decode: bool = True) -> DataFrame:
    """docs with the columns ids (array of int) and decoded (string) in place of any of these names.

    With `digests` n_ids, ids_md5 (over the ids as little-endian 32-bit numbers) and round_trip follow, all derived from
    these two columns; round_trip is whether decoded is the text, which it is not where the text holds a literal mark.
    Without `decode` there are ids alone.

    ids are the library's for the whole text; decoded is what decoding the ids gives, the text itself but for marks
    that the text holds literally. Null texts are empty and have no ids. All other columns pass through unread, whatever their names; an
    empty table gives an empty one. `path` names a model file that each executor has.
    """
    if digests and not decode:
        raise ValueError("digests are derived from the decoded text")
    added = ADDED + DIGESTS if digests else ADDED if decode else ADDED[:1]
    kept = [c for c in docs.columns if c not in added]
    given = docs.select(*quoted(kept), docs[text].alias(fresh(docs.columns, "text"))) if text not in kept else docs.select(*quoted(kept))
    at = kept.index(text) if text in kept else len(kept)
    schema = docs.select(*quoted(kept)).schema.add("ids", T.ArrayType(T.IntegerType(), False), False)
    if decode:
        schema = schema.add("decoded", "string", False)
    if digests:
        schema = schema.add("n_ids", "long", False).add("ids_md5", "string", False).add("round_trip", "boolean", False)

    def flushed(spm: Encoder, held: list[tuple[pa.RecordBatch, list[str]]]) -> Iterator[pa.RecordBatch]:
        every, at_ = spm.encode([t for _, texts in held for t in texts]), 0
        for b, texts in held:
            ids, at_ = every[at_ : at_ + len(texts)], at_ + len(texts)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), np.int32)
            out = [*(b.column(k) for k in range(len(kept))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            if decode:
                decoded = [spm.model.decode(x) for x in ids]
                out.append(pa.array(decoded, pa.string()))
            if digests:
                same = [d == t for d, t in zip(decoded, texts)]
                md5 = [hashlib.md5(x.tobytes()).hexdigest() for x in ids]
                out += [pa.array(map(len, ids), pa.int64()), pa.array(md5, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, [*kept, *added])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spm, held, size = encoder(path), [], 0
        for b in slices(batches):
            held.append((b, [t or "" for t in b.column(at).to_pylist()]))
            size += sum(map(len, held[-1][1]))
            if size >= GROUP:
                yield from flushed(spm, held)
                held, size = [], 0
        yield from flushed(spm, held)

    return mapped(given, of, schema)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, the text decoded from them, their number and digest, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, model_path(), digests=True).select("doc_id", *ADDED, *DIGESTS)
