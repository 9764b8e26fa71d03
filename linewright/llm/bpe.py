"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut into leaves of equal length, wherever that falls; leaves are encoded on their own and joined pairwise up a
tree. At each join a window around the seam is encoded again and grown until both sides agree with it. The same is done one level
below: a piece that stays long after splitting (a run of letters, digits, signs or white space) is cut into leaves of
byte characters, which are joined by tokens.

Leaves are merged by the faster of two libraries where the file allows it: if the merges of the file are in the order of
their ids and its splitting is the usual byte-level one, both give the same ids. Other files split texts in ways that are not
known here: their texts go to the tokenizer as they are, and only long pieces are joined by trees.

Why joins of texts are exact: splitting reads from left to right and looks at nothing before the place where a piece begins, and
no piece holds a letter or digit followed by a space. So such a place is an edge of pieces in either side, in the window and in
the whole text, and what stands between two of them is encoded alike in all of these.

Why joins of tokens are exact: a token sequence is the BPE encoding of its text if and only if every two adjacent
tokens are the encoding of their own text. In the joined sequence every adjacent pair stands either in one side's
encoding or in the window's, since they meet in common tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import append

# A piece of more characters than this is encoded by tree concatenation.
LEAF = 4096
# A text of more characters than this is.
PART = 512
# Fixed value: how byte-level tokenizers of this kind cut text into pieces.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
_BATCH_CHARS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """One tokenizer file, loaded once per Python worker."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, part: int = PART):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # The merges alone: a string of byte characters is one piece.
        self.merges = Tokenizer(self.whole.model)
        self.leaf, self.window, self.part = leaf, window, part
        size = self.whole.get_vocab_size()
        self.lengths = [len(self.whole.id_to_token(i) or "") for i in range(size)]
        self.tokens = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.sizes = list(self.lengths)
        for token, i in self.special.items():
            self.sizes[i] = len(token.encode())
        self.fast = self._by_rank(path)

    def _by_rank(self, path: str):
        """The same encoding by ranks, or None if the file does something else besides."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules["pre_tokenizer"] or {}
        plain = (
            rules["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"]) for t in rules["added_tokens"])
            and not rules["model"].get("ignore_merges")
        )
        vocabulary = {t: i for t, i in rules["model"]["vocab"].items() if t not in self.special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in rules["model"]["merges"]]
        if not plain or [vocabulary.get(m) for m in merges] != list(range(256, 256 + len(merges))) or len(vocabulary) != 256 + len(merges):
            return None
        # Byte characters in the order of their ids stand for bytes in the order of this list.
        order = [b for b in range(256) if chr(b).isprintable() and b not in (32, 127, 160, 173)]
        order += [b for b in range(256) if b not in order]
        byte = {token: order[i] for token, i in vocabulary.items() if i < 256}
        if len(byte) != 256:
            return None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("by rank", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of every text, as the tokenizer gives them without added special tokens."""
        long = [self._has_long_piece(t) for t in texts]
        short = [t for t, x in zip(texts, long) if not x]
        if self.fast:
            plain = iter([self.text_tree(t) for t in short])
        else:
            plain = iter([x.ids for x in self.whole.encode_batch_fast(short, add_special_tokens=False)])
        return [self._encode_long(t) if x else next(plain) for t, x in zip(texts, long)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def text_tree(self, text: str) -> list[int]:
        """Ids of one text, by leaves of `part` characters that are joined pairwise."""
        cuts = [*range(0, len(text), self.part), len(text)] if text else [0, 0]
        level = [(a, b, self.fast.encode(text[a:b], allowed_special="all")) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            pairs = zip(level[::2], level[1::2])
            level = [self._join_texts(text, *pair) for pair in pairs] + (level[-1:] if len(level) % 2 else [])
        return level[0][2]

    def _join_texts(self, text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> tuple[int, int, list[int]]:
        (start, seam, before), (_, end, after) = left, right
        width = self.window
        while True:
            # The outermost edges within the window, or the ends of the sides.
            low, high = max(start, seam - width), min(end, seam + width)
            low = low if low == start else _edge(text, low, seam)
            high = high if high == end else _last_edge(text, seam, high)
            if low is not None and high is not None:
                kept = self._fitting(reversed(before), len(text[low:seam].encode()))
                dropped = self._fitting(after, len(text[seam:high].encode()))
                if kept is not None and dropped is not None:
                    seen = self.fast.encode(text[low:high], allowed_special="all")
                    return start, end, before[: len(before) - kept] + seen + after[dropped:]
            width *= 2

    def _fitting(self, ids: Iterable[int], size: int) -> int | None:
        """How many of the ids make up `size` bytes; None if one stands across that place."""
        n = 0
        for i in ids if size else ():
            n, size = n + 1, size - self.sizes[i]
            if size <= 0:
                break
        return None if size else n

    def _has_long_piece(self, text: str) -> bool:
        # Pieces hold a space only in front or in runs of white space.
        return len(text) > self.leaf and (max(map(len, text.split(" "))) >= self.leaf - 1 or " " * self.leaf in text)

    def _encode_long(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._around_special(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            pieces = [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(part)]
            for piece, ids in zip(pieces, self.merges.encode_batch_fast([p if len(p) <= self.leaf else "" for p in pieces], add_special_tokens=False)):
                out.extend(ids.ids if len(piece) <= self.leaf else self.tree(piece))
        return out

    def _around_special(self, text: str) -> Iterator[str]:
        import re

        if not self.special:
            yield text
            return
        # Longer names first, as the leftmost longest one counts.
        names = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        yield from (x for x in re.split(f"({names})", text) if x)

    def tree(self, piece: str) -> list[int]:
        """Ids of one piece, given in byte characters."""
        cuts = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        level = [x.ids for x in self.merges.encode_batch_fast(cuts, add_special_tokens=False)]
        while len(level) > 1:
            pairs = list(zip(level[::2], level[1::2]))
            level = self._join(pairs) + level[len(pairs) * 2 :]
        return level[0]

    def _join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        done: dict[int, list[int]] = {}
        width = self.window
        while len(done) < len(pairs):
            open_ = [k for k in range(len(pairs)) if k not in done]
            windows = ["".join(self.tokens[i] for i in pairs[k][0][-width:] + pairs[k][1][:width]) for k in open_]
            for k, seen in zip(open_, self.merges.encode_batch_fast(windows, add_special_tokens=False)):
                joined = self._agreed(*pairs[k], seen.ids, width)
                if joined is not None:
                    done[k] = joined
            width *= 2
        return [done[k] for k in range(len(pairs))]

    def _agreed(self, left: list[int], right: list[int], seen: list[int], width: int) -> list[int] | None:
        """The whole sequence, or None if the window shares no token with one of the sides."""
        first = max(0, len(left) - width)
        last = min(width, len(right))
        seam = sum(self.lengths[i] for i in left[first:])
        end = seam + sum(self.lengths[i] for i in right[:last])
        places = {}
        at = 0
        for n, i in enumerate(seen):
            places[at, at + self.lengths[i]] = n
            at += self.lengths[i]
        from_left = 0 if first == 0 else None
        keep_left: list[int] = []
        at = seam
        for n in range(len(left) - 1, first - 1, -1):
            span = (at - self.lengths[left[n]], at)
            at = span[0]
            if span in places:
                keep_left, from_left = left[: n + 1], places[span] + 1
                break
        to_right = len(seen) if last == len(right) else None
        keep_right: list[int] = []
        at = seam
        for n in range(last):
            span = (at, at + self.lengths[right[n]])
            at = span[1]
            if span in places:
                keep_right, to_right = right[n:], places[span]
                break
        assert at <= end
        if from_left is None or to_right is None:
            return None
        return keep_left + seen[from_left:to_right] + keep_right


def _edge(text: str, low: int, high: int) -> int | None:
    """The first place from `low` up to `high` where a space comes after a letter or digit."""
    at = text.find(" ", low, high + 1)
    while at >= 0 and not (at and text[at - 1].isalnum()):
        at = text.find(" ", at + 1, high + 1)
    return at if at >= 0 else None


def _last_edge(text: str, low: int, high: int) -> int | None:
    """The last such place."""
    at = text.rfind(" ", low, high + 1)
    while at >= 0 and not (at and text[at - 1].isalnum()):
        at = text.rfind(" ", low, at)
    return at if at >= 0 else None


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def _groups(texts: Sequence[str | None]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text or "") > _BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(text or "")
        size += len(text or "")
    if group:
        yield group


def encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """`df` with the ids of every whole text as array<int>; null text counts as empty and gives no ids.

    A column of the name `out_col` is replaced.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.Array:
        bpe = loaded(path)
        rows = [np.array(ids, np.int32) for g in _groups(batch[text_col].to_pylist()) for ids in bpe.encode(g)]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate(rows) if rows else np.zeros(0, np.int32))

    return append(df, out_col, "array<int>", run)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`df` with the text of every id list, special tokens included; null or no ids give an empty text.

    A column of the name `out_col` is replaced.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.Array:
        lists = batch[ids_col]
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        return pa.array(loaded(path).decode([flat[a:b] for a, b in zip([0, *ends], ends)]), pa.string())

    return append(df, out_col, "string", run)
