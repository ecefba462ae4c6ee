"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a word the encoding is that of a shorter prefix plus one last token:
the only vocabulary suffix whose pair with the shorter prefix's last token is stable under
the merges. That gives the exact count at *every* prefix in one left-to-right pass. Words are
independent of each other, so a text's ledger is its words' count changes, one signed byte a
character, and truncation and budget questions read the ledger without encoding anything again.
Where only totals are asked for (packing), words are counted by the tokenizer library itself.

Edge cases: null and empty texts have no characters and no tokens; special tokens' strings
count as the tokenizer's default has them (one token each); repeated rows, an empty table
and further columns of any name are as usual; a text of any length is counted whole. A run of blanks of any length is handled like a word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.blocks import claim, documents, map_rows

#: Words whose count changes are kept by each worker (twice: the older half goes first), the characters of the longest, and pairs of tokens.
CACHE_WORDS, LONGEST_CACHED, CACHE_PAIRS = 300_000, 64, 500_000
#: The characters that vocabularies' patterns take for blanks (fixed values).
_BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Blanks with what follows them up to the next blank: no word reaches over their ends.
_RUN = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What can be told apart without looking at its neighbours: blanks with the word after them.
_PIECE = regex.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
#: The same in the standard library's classes, which is faster, for texts of characters that both class alike.
_QUICK = re.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+")
_CLASSES = [(regex.compile(a), re.compile(b)) for a, b in ((r"\s", r"\s"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"))]


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every character prefix of a text, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = at
            #: token -> (rank, left part, right part) of the merge that makes it
            self.made.setdefault(raw(a) + raw(b), (at, raw(a), raw(b)))
        special = {x["content"] for x in spec.get("added_tokens", ())}
        self.tokens = sorted({raw(t) for t in spec["model"]["vocab"] if t not in special})
        self._automaton()
        #: Strings that the tokenizer takes whole, wherever they stand.
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.plain = sorted(special)
        self.stable: dict[int, bool] = {}
        self.young, self.old = _Pieces(self), {}
        self.even: set[str] = set()  # characters that re and regex class alike
        self.odd: set[str] = set()

    def _automaton(self) -> None:
        """A trie of the vocabulary with links to the longest suffix, so that the tokens that end at a byte are walked from the longest on."""
        self.size = [len(t) for t in self.tokens]
        self.child: dict[int, int] = {}
        edges, ends = [], [-1]  # (node, parent, byte) of all nodes but the root; the token that each node is
        for i, t in enumerate(self.tokens):
            node = 0
            for c in t:
                new = self.child.get(node << 8 | c)
                if new is None:
                    new = self.child[node << 8 | c] = len(ends)
                    edges.append((new, node, c))
                    ends.append(-1)
                node = new
            ends[node] = i
        depth = [0] * len(ends)
        for node, parent, _ in edges:
            depth[node] = depth[parent] + 1
        self.fail, self.longest = [0] * len(ends), ends.copy()
        #: token -> the longest other token that it ends with
        self.shorter = [-1] * len(self.tokens)
        for node, parent, c in sorted(edges, key=lambda x: depth[x[0]]):
            up = self.fail[parent]
            while up and (up << 8 | c) not in self.child:
                up = self.fail[up]
            self.fail[node] = self.child.get(up << 8 | c, 0) if parent else 0
            below = self.longest[self.fail[node]]
            if ends[node] >= 0:
                self.shorter[ends[node]] = below
            else:
                self.longest[node] = below

    def merged(self, raw: bytes) -> list[bytes]:
        """The encoding by the merges themselves: the plain way, for comparison."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, at = [], 0
            while at < len(parts):
                if at + 1 < len(parts) and (parts[at], parts[at + 1]) == best:
                    out.append(parts[at] + parts[at + 1])
                    at += 2
                else:
                    out.append(parts[at])
                    at += 1
            parts = out
        return parts

    def pair_stays(self, a: bytes, b: bytes) -> bool:
        """Do the merges keep this pair of tokens apart?

        Merges are undone from the last one on, at the two parts beside the border. The pair falls if
        those parts could have been merged before what has been undone; of equal merges the left one comes first."""
        left, right, before = a, b, 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < before:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                before, left = made_left[0], made_left[2]
            else:
                before, right = made_right[0] + 1, made_right[1]

    def word(self, raw: bytes) -> list[int]:
        """Tokens of each byte prefix of one word, from 0 bytes on: the dynamic programme."""
        child, fail, longest, size, shorter, stable = self.child, self.fail, self.longest, self.size, self.shorter, self.stable
        counts, last, node = [0], [-1], 0
        for end, c in enumerate(raw, 1):
            while (new := child.get(node << 8 | c)) is None and node:
                node = fail[node]
            node = new or 0
            token = longest[node]
            while token >= 0 and (start := end - size[token]):
                pair = last[start] << 32 | token
                if (stays := stable.get(pair)) is None:
                    if len(stable) > CACHE_PAIRS:
                        stable.clear()
                    stays = stable[pair] = self.pair_stays(self.tokens[last[start]], self.tokens[token])
                if stays:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            counts.append(counts[start] + 1)
            last.append(token)
        return counts

    def piece(self, piece: str) -> bytes:
        """Changes of the count, a signed byte for each character of a piece."""
        if piece.isascii() and (piece if piece[0] != " " else piece[1:]).isalpha():  # one word of one-byte characters
            counts = self.word(piece.encode())
            return bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])
        totals, base = [0], 0
        words = _WORD.findall(piece)
        for at, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            counts = self.word(raw)
            if len(raw) == len(word):
                mine = counts[1:]
            else:
                mine = [counts[e] for e in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]
            if len(word) == 3 and word in ("'re", "'ve", "'ll"):  # its first two characters are two words
                mine[1] = mine[0] + self.word(raw[1:2])[-1]
            mine = [base + c for c in mine]
            if at and words[at - 1].isspace():  # up to the word's first blank, all blanks so far are one word
                blanks = words[at - 1] + word[0]
                if blanks.isspace():
                    mine[0] = base - self.word(words[at - 1].encode())[-1] + self.word(blanks.encode())[-1]
            totals += mine
            base += counts[-1]
        return bytes([b - a & 255 for a, b in zip(totals, totals[1:], strict=False)])

    def changes(self, text: str) -> bytes:
        """A text's ledger: the change of the count at each character, as signed bytes."""
        if self.special is not None and any(s in text for s in self.plain):
            out, at = [], 0
            for m in self.special.finditer(text):
                head, whole = self.changes_plain(text[at : m.start()]), np.frombuffer(self.changes_plain(m[0]), np.int8).copy()
                whole[-1] += 1 - int(whole.sum())
                out += [head, whole.tobytes()]
                at = m.end()
            return b"".join([*out, self.changes_plain(text[at:])])
        return self.changes_plain(text)

    def pieces(self, text: str) -> list[str]:
        chars = set(text)
        if not chars <= self.even:
            for c in chars - self.even - self.odd:
                alike = all(bool(a.match(c)) == bool(b.match(c)) for a, b in _CLASSES)
                (self.even if alike else self.odd).add(c)
        return (_PIECE if chars & self.odd else _QUICK).findall(text)

    def changes_plain(self, text: str) -> bytes:
        out = b"".join(map(self.young.__getitem__, self.pieces(text)))
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = _Pieces(self), self.young
        return out


class _Pieces(dict):
    """piece -> its changes, made where they are missing."""

    def __init__(self, of: PrefixCounter):
        super().__init__()
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        got = self.of.old.get(piece) or self.of.piece(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = got
        return got


class _Recent(dict):
    """key -> its count, made where it is missing. Past ``most`` keys, those that were not asked for since the last time go."""

    def __init__(self, make: Callable[[str], int], most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> int:
        if (got := self.old.get(key)) is None:
            got = self.make(key)
        if len(key) <= LONGEST_CACHED:
            self[key] = got
        return got

    def total(self, keys: list[str]) -> int:
        out = sum(map(self.__getitem__, keys))
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return out


class TotalCounter:
    """Exact token counts of whole texts where no ledger is asked for: words are counted by the tokenizer library, and looked up after that."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = {x["content"] for x in json.load(f).get("added_tokens", ())}
        self.special = sorted(added, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if added else None
        self.model = Tokenizer.from_file(path).model
        self.letter = {b: c for c, b in _byte_letters().items()}
        self.words, self.runs, self.after_space = _Recent(self.word), _Recent(self.run), _Recent(lambda run: self.run(" " + run))

    def word(self, word: str) -> int:
        return len(self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letter)))

    def run(self, run: str) -> int:
        return self.words.total(_WORD.findall(run))

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.split.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if any(c + " " in text for c in set(text) if c.isspace()):
            return self.runs.total(_RUN.findall(text))
        first, *rest = text.split(" ")  # a space after no blank begins a run
        return (self.runs.total(_RUN.findall(first)) if first else 0) + self.after_space.total(rest)


def total(changes: bytes) -> int:
    return int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))


def prefix_counts(ledger: bytes | None) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters, from a stored ledger."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(ledger) if ledger else b""
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)])


def longest_within(ledger: bytes | None, budget: int) -> int:
    """Characters of the longest prefix that encodes to at most that many tokens."""
    return int(np.flatnonzero(prefix_counts(ledger) <= budget)[-1])


_COUNTERS: dict[tuple, PrefixCounter | TotalCounter] = {}


def counter(path: str, kind: type = PrefixCounter) -> PrefixCounter | TotalCounter:
    """One counter of each kind for each worker process and file."""
    if (kind, path) not in _COUNTERS:
        _COUNTERS[kind, path] = kind(path)
    return _COUNTERS[kind, path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", ledger: bool = True, id_col: str = "doc_id", text_col: str = "text", path: Callable[[str], str] = tokenizer_path) -> DataFrame:
    """id, n_bytes, n_tokens and, if asked for, the compressed ledger of each document. No shuffle."""

    def run(ids, texts):
        import zstandard

        claim("tokens", _COUNTERS.clear)
        out = {"id": ids, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]}
        if not ledger:
            return out | {"n_tokens": list(map(counter(path(tokenizer), TotalCounter).count, (t or "" for t in texts)))}
        count, pack = counter(path(tokenizer)), zstandard.ZstdCompressor(level=1)
        found = [count.changes(t or "") for t in texts]
        return out | {"n_tokens": [total(c) for c in found], "ledger": [pack.compress(c) for c in found]}

    return map_rows(df, run, "id long, n_bytes long, n_tokens long" + ", ledger binary" * ledger, id_col, text_col)


def op1_tokens(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    from pyspark.sql import functions as F

    rows = token_counts(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("ledger").alias("prefix_ledger"))
