"""Token counts without ids: pieces per distinct pre-token times its frequency in the document.

The join of pre-token counts to per-document frequencies runs inside each task, against a bounded memo of the
pre-tokens seen by that Python worker. A global join would shuffle a row for each document and distinct
pre-token, several times the text itself, for a count that a task can make on its own.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.llm.common import slices, table

LIMIT, MEMO = 512, 300_000
#: Byte-level pre-tokens, as published with the vocabulary. A fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Stands before a span that no space preceded; a span of another kind never begins with a space.
_BARE = " "
_UNSAFE = re.compile(r"\A | \Z| \s|\s ")


def spans(text: str) -> list[str]:
    """text cut before each space that stands between two other characters; each part but the first lost that space.

    No pre-token goes past such a space, so that parts can be counted on their own.
    """
    return text.split(" ") if not _UNSAFE.search(text) else _LONE_SPACE.split(text)


class PieceCounter:
    """Counts of one vocabulary. Spans and pre-tokens of late are kept, each in two generations of about `memo`."""

    def __init__(self, path: str, memo: int = MEMO):
        self.memo, self.special = memo, None
        self.known, self.older = {}, {}
        self.pieces, self.older_pieces = {}, {}
        kind = path.rpartition(".")[2]
        if kind == "json":
            self._tokenizers(path)
        elif kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.units, self.whole = None, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}")

    def _tokenizers(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.whole = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if spec["normalizer"] or not plain or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            self.units = None  # pre-tokens depend on more than the pattern
            return
        self.units: Callable[[str], list[str]] = regex.compile(BYTE_LEVEL).findall
        if added:
            self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if self.units is None:
            return self.whole(texts) if texts else []
        totals, frequencies = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            totals.append(len(parts) - 1)
            f: Counter = Counter()
            for part in parts:
                if part:
                    first, *rest = spans(part)
                    f.update(rest)
                    f[_BARE + first] += 1
            frequencies.append(f)
        self._learn(set().union(*frequencies))
        known = self.known
        return [n + sum(known[s] * k for s, k in f.items()) for n, f in zip(totals, frequencies)]

    def _learn(self, seen: set[str]) -> None:
        """Pieces of spans not yet known, by way of their distinct pre-tokens."""
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        if len(self.pieces) > self.memo:
            self.pieces, self.older_pieces = {}, self.pieces
        parts = {}
        for s in seen:
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    parts[s] = self.units(s[1:] if s[:1] == _BARE else f" {s}")
        new = []
        for u in {u for p in parts.values() for u in p}:
            if u not in self.pieces:
                if u in self.older_pieces:
                    self.pieces[u] = self.older_pieces[u]
                else:
                    new.append(u)
        if new:
            self.pieces.update(zip(new, self.whole(new)))
        for s, p in parts.items():
            self.known[s] = sum(map(self.pieces.__getitem__, p))


_COUNTERS: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    Null texts are empty: no bytes, no tokens. Null and repeated ids pass through; other columns play no part.
    `path` names a vocabulary file that each executor has, .json or .model.
    """
    schema = docs.select(F.col(key)).schema.add("n_bytes", "long", False).add("n_tokens", "long", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = PieceCounter(path)
        counter = _COUNTERS[path]
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counter.counts(texts), pa.int64())], [key, "n_bytes", "n_tokens"])

    sized = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(of, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
