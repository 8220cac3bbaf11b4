"""BPE encoding and decoding over a trie of distinct words, sharing the work for common prefixes.

A BPE encoding is fixed by its last token: a sequence of tokens is the encoding of its text exactly when every
two neighbours stay apart under the merge rules. So the last token of a prefix is the one token that ends the
prefix and stays apart from the last token of what is before it. The distinct words of a batch are put in order;
in that order they are a trie walked depth first, neighbours sharing the path of their common prefix. The states
(last tokens) of the current path are kept on a stack, and only the steps below the common prefix are computed.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded alike; the strings of
special tokens in a text become those tokens; columns other than ``text`` pass through untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, with_fields

CACHED_CHUNKS = 200_000
CACHED_PAIRS = 500_000
LONG_CHUNK = 48  # longer chunks are encoded, but not remembered
NEVER = 1 << 60
# White space as Unicode defines it; str.split also breaks at U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")
SPLIT_AT_SPACE = re.compile(f"[{SPACE}]+")
# Fixed value: the pieces of this vocabulary's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next code point from 256."""
    letters, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class WordBpe:
    """Encoder and decoder built from a vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str, specials: dict[str, int]):
        self.vocab, self.end, self.specials = vocab, end, specials
        self.width = max([*vocab.values(), *specials.values()]) + 1
        self.tokens = [""] * self.width
        for token, i in [*vocab.items(), *specials.items()]:
            self.tokens[i] = token
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left part, right part, rank
        for k, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(left * self.width + right, k)
            self.parts.setdefault(whole, (left, right, k))
        self.longest: dict[str, int] = {}  # by up to three last letters (or two and the end mark)
        for token in vocab:
            for tail in {token[-n:] for n in (1, 2, 3)} if not token.endswith(end) else {token[-n - len(end):] for n in (1, 2)}:
                letters = len(token) - (len(end) if token.endswith(end) else 0)
                self.longest[tail] = max(self.longest.get(tail, 0), letters)
        self.letters = byte_letters()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.right_edges: dict[int, list[tuple[int, int]]] = {}
        self.left_edges: dict[int, list[tuple[int, int]]] = {}
        self.apart_pairs: dict[int, bool] = {}
        self.single: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    # -- which tokens may stand side by side ---------------------------------------------------------------------

    def edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token``, from a single letter up to itself, each with the rank that forms it."""
        known = self.right_edges if side else self.left_edges
        if (found := known.get(token)) is None:
            found = [(token, -1)]
            if token in self.parts:
                part = self.parts[token]
                found = [*self.edges(part[side], side), (token, part[2])]
            known[token] = found
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a boundary between the texts of ``a`` and ``b``.

        Both edges grow in the order of ranks; the boundary is lost if a merge across it comes first. Among
        equal ranks the one further left is applied first.
        """
        key = a * self.width + b
        if (known := self.apart_pairs.get(key)) is not None:
            return known
        left, right = self.edges(a, 1), self.edges(b, 0)
        i = j = 0
        rank, width = self.rank, self.width
        while True:
            x = left[i + 1][1] if i + 1 < len(left) else NEVER
            y = right[j + 1][1] if j + 1 < len(right) else NEVER
            across = rank.get(left[i][0] * width + right[j][0], NEVER)
            if across < x and across <= y and across < NEVER:
                result = False
                break
            if x == y == NEVER:
                result = True
                break
            if x <= y:
                i += 1
            else:
                j += 1
        if len(self.apart_pairs) >= CACHED_PAIRS:
            self.apart_pairs.clear()
        self.apart_pairs[key] = result
        return result

    def alone(self, token: int) -> bool:
        """Whether the text of ``token`` is encoded as that one token: its parts must be so, and meet at its rank."""
        if (known := self.single.get(token)) is None:
            known = True
            if token in self.parts:
                a, b, k = self.parts[token]
                known = self.alone(a) and self.alone(b) and self.meet(a, b, k)
            self.single[token] = known
        return known

    def meet(self, a: int, b: int, k: int) -> bool:
        """Whether ``a`` and ``b`` are both complete before anything merges across their boundary."""
        left, right = self.edges(a, 1), self.edges(b, 0)
        i = j = 0
        while i + 1 < len(left) or j + 1 < len(right):
            x = left[i + 1][1] if i + 1 < len(left) else NEVER
            y = right[j + 1][1] if j + 1 < len(right) else NEVER
            across = self.rank.get(left[i][0] * self.width + right[j][0], NEVER)
            if across < x and across <= y:
                return False
            if x <= y:
                i += 1
            else:
                j += 1
        return self.rank.get(a * self.width + b) == k

    # -- the trie --------------------------------------------------------------------------------------------------

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of each word (in byte letters), walking the trie of all the words once.

        ``last`` and ``size`` hold, for every number of letters of the current path, the last token and its letters.
        Only at the end of a word may a token carry the end mark.
        """
        found: dict[str, list[int]] = {}
        vocab, longest, pairs, single, width = self.vocab.get, self.longest.get, self.apart_pairs.get, self.single.get, self.width
        last, size = [-1], [0]
        before = ""
        for word in sorted(words):
            letters = len(word)
            same, most = 0, min(len(before), letters)
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1:], size[same + 1:]
            for i in range(len(last), letters + 1):
                # of the tails that end tokens, three letters are looked up, or two and the end mark
                if i < letters or not self.end:
                    end, top = "", longest(word[i - 3 if i > 3 else 0:i], 2)
                else:
                    end = self.end
                    top = longest(word[i - 2 if i > 2 else 0:i] + end, 1)
                for n in range(top if top < i else i, 0, -1):
                    token = vocab(word[i - n:i] + end)
                    if token is None:
                        continue
                    if n == i:
                        if (good := single(token)) is None:
                            good = self.alone(token)
                    elif (good := pairs(last[i - n] * width + token)) is None:
                        good = self.apart(last[i - n], token)
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}")
                if i < letters:
                    last.append(token)
                    size.append(n)
            ids, left = [token], letters - n
            while left:
                ids.append(last[left])
                left -= size[left]
            ids.reverse()
            found[word] = ids
            before = word
        return found

    # -- texts -----------------------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """Composed form and lower case, letter by letter (so the final sigma has no form of its own)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks (texts without white space) as packed int32."""
        pieces = {c: WORDS.findall(c) for c in chunks}
        counts = Counter([p for found in pieces.values() for p in found])
        letters, known = self.letters, self.words
        if len(known) > CACHED_CHUNKS:
            known.clear()
        spelled = {p: p if p.isascii() and p.isalnum() else "".join([letters[b] for b in p.encode()]) for p in counts if p not in known}
        ids = self.encode_words(set(spelled.values()))
        new = {p: array("i", ids[s]).tobytes() for p, s in spelled.items()}
        known.update(new)
        out = {c: known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found]) for c, found in pieces.items()}
        for p in new:
            if counts[p] == 1:  # most words come once; the others are worth keeping
                del known[p]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts."""
        rows: list[list[str | bytes]] = []
        counts: Counter[str] = Counter()
        chunks = self.chunks
        if len(chunks) > CACHED_CHUNKS:
            chunks.clear()
        for text in texts:
            row: list[str | bytes] = []
            parts = self.special_pattern.split(text or "") if self.special_pattern else [text or ""]
            for k, part in enumerate(parts):
                if k % 2:
                    row.append(np.int32(self.specials[part]).tobytes())
                elif part:
                    part = self.normal(part)
                    own = part.split() if not SEPARATORS.search(part) else [c for c in SPLIT_AT_SPACE.split(part) if c]
                    row.extend(own)
                    counts.update(own)
            rows.append(row)
        new = self.learn(counts.keys() - chunks.keys())
        chunks.update(new)
        out = [np.frombuffer(b"".join([c if type(c) is bytes else chunks[c] for c in row]), np.int32) for row in rows]
        for c in new:
            if counts[c] == 1 or len(c) > LONG_CHUNK:
                del chunks[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by blanks: this vocabulary has no decoder of its own."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


_built: dict[int, WordBpe] = {}


def load(path: str) -> dict:
    """What an encoder needs of a tokenizer file, read once on the driver (a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "end": model["end_of_word_suffix"] or "",
            "specials": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def encoder(spec: dict) -> WordBpe:
    """The encoder of this Python process."""
    key = hash((len(spec["vocab"]), len(spec["merges"]), tuple(spec["merges"][-3:]), tuple(spec["specials"].items())))
    if key not in _built:
        _built.clear()
        _built[key] = WordBpe(**spec)
    return _built[key]


def encode_texts(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The ``keep`` columns with ``ids array<int>`` and ``decoded string`` of every whole text."""
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value)
        for b in batches:
            ids = bpe.encode_batch(b.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), lists, decoded], names=[*keep, "ids", "decoded"])

    return map_texts(source, run, with_fields(docs, keep, "ids array<int>, decoded string"))
