"""Operator 2: byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a cut between its two
bytes is certain.  Every pre-token is cut there, the fragments are encoded independently (and remembered, since
fragments recur far more often than words), and the pieces are concatenated.  Nothing is shuffled: a text is
encoded where it is read.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; special
strings inside a text become their special ids, as the tokenizers library does by default.  Extra columns are
ignored; repeated rows give repeated results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Unicode White_Space; the split pattern of GPT-2's byte-level pre-tokenizer; blocks whose letters,
# numbers and lower case are the same in every Unicode version that the engines here know.
WHITE = "\t-\r\x20\x85\xa0  -     　"
SETTLED = "\x00-\u052f\u0590-\u06ff\u0900-\u0bff\u1e00-\u2070\u20a0-\u2bff\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001faff"
GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_WORDS = 300_000  # a worker's memory of words; emptied when full

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE gives each byte: itself where printable, else 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A BPE vocabulary of the tokenizers library, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.token_of_text = {str(i): t for i, t in self.tokens.items()}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.byte_decoded = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.normalizers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), GPT2_SPLIT)
        self.split = regex.compile(pattern.replace(r"\s", WHITE) if "[" + r"^\s" in pattern and pattern != GPT2_SPLIT else pattern)
        # texts of the Latin blocks take the built-in engine: the same pattern, its classes spelled out for U+0000 to U+017F
        self.latin = None
        if pattern != GPT2_SPLIT:
            letters = "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L")
            numbers = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
            known = r"\p{L}" in pattern and r"\p{N}" in pattern
            spelled = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{letters}{numbers}]")
            self.latin = re.compile(spelled) if known and r"\p" not in spelled else None
        self.beyond_latin = re.compile("[^\x00-\u017f]")
        self.unsettled = re.compile(f"[^{SETTLED}]")
        self.library = tokenizers.Tokenizer.from_file(path)  # normalises and splits what lies outside the settled blocks
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inside = self._pairs_inside()
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _pairs_inside(self) -> set[str]:
        """Every pair of adjacent byte letters that some vocabulary token holds; a cut elsewhere is certain."""
        found = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            found.update(body[i : i + 2] for i in range(len(body) - 1))
        return found

    def normalize(self, text: str) -> str:
        for step in self.normalizers:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Replace":
                text = text if text.isascii() and text.isprintable() else re.sub(f"[{WHITE}]+", " ", text)
            elif step == "Lowercase":  # letter by letter: no final-sigma rule
                text = text.replace("Σ", "σ").lower()
        return text

    def cut(self, letters: str) -> list[str]:
        """The fragments between certain cuts."""
        at = [0, *(i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in self.inside), len(letters)]
        return [letters[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """The ids of one fragment: lowest-ranked merge first, leftmost first, over a heap of neighbours."""
        parts = list(fragment)
        if last and self.suffix:
            parts[-1] += self.suffix
        if len(parts) <= 32:
            return self._merge_short(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * len(parts)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(parts) or parts[i] != left or parts[j] != right:
                continue
            parts[i], gone[j], after[i] = left + right, True, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return tuple(self.vocab[p] for p, dead in zip(parts, gone, strict=True) if not dead)

    def _merge_short(self, parts: list[str]) -> tuple[int, ...]:
        """The same merges by looking at every neighbouring pair again, which is quicker for a few letters."""
        get, never = self.ranks.get, len(self.ranks)
        while len(parts) > 1:
            ranks = [get(p, never) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple([self.vocab[p] for p in parts])

    def word(self, word: str) -> tuple[int, ...]:
        letters = "".join([self.letters[b] for b in word.encode("utf-8")])
        pieces, ids = self.cut(letters), ()
        for k, piece in enumerate(pieces):
            key = (piece, k == len(pieces) - 1)
            got = self.fragments.get(key)
            if got is None:
                got = self.merge(*key)
                if len(piece) <= 64:
                    self.fragments[key] = got
            ids += got
        return ids

    def stretches(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special ids and, between them, lists of pre-tokens."""
        for k, part in enumerate(self.specials.split(text) if self.specials and "<" in text else [text]):
            if k % 2:
                yield self.special[part], []
            elif part:
                yield None, self.pretokens(part)

    def pretokens(self, part: str) -> list[str]:
        if self.unsettled.search(part):
            part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            return [bytes([self.byte_of[c] for c in piece]).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        part = self.normalize(part)
        return (self.split if self.latin is None or self.beyond_latin.search(part) else self.latin).findall(part)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for special, words in self.stretches(text or ""):
            if special is not None:
                ids.append(special)
            for w in words:
                got = self.words.get(w)
                ids.extend(self._learn(w) if got is None else got)
        return ids

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.words) >= MEMO_WORDS:
            self.words.clear()
            self.fragments.clear()
        got = self.word(word)
        if len(word) <= 64:
            self.words[word] = got
        return got

    def decode(self, ids) -> str:
        """As the library's decode with skip_special_tokens=False: without a decoder, tokens joined by a space."""
        text = map(self.tokens.__getitem__, ids)
        if self.byte_decoded:
            return bytes(self.byte_of[c] for c in "".join(text)).decode("utf-8", "replace")
        return " ".join(text)


class Counts(dict):
    """Word -> number of ids, for counting without ids."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        n = len(self.bpe.word(word))
        if len(word) <= 64:
            self[word] = n
        return n


class Strings(dict):
    """Word -> its ids in decimal, joined by a space."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        s = " ".join(map(str, self.bpe.word(word)))
        if len(word) <= 64:
            self[word] = s
        return s


_loaded: dict[str, tuple[Bpe, Counts, Strings]] = {}


def loaded(path: str) -> tuple[Bpe, Counts, Strings]:
    """One vocabulary a worker, kept between its tasks."""
    if path not in _loaded:
        bpe = Bpe(path)
        _loaded[path] = bpe, Counts(bpe), Strings(bpe)
    bpe, counts, strings = _loaded[path]
    for memo in (counts, strings, bpe.fragments):
        if len(memo) > MEMO_WORDS:
            memo.clear()
    return bpe, counts, strings


def decimal_ids(text: str | None, path: str) -> str:
    """A text's ids in decimal, joined by one space."""
    bpe, _, strings = loaded(path)
    out = []
    for special, words in bpe.stretches(text or ""):
        out.extend([str(special)] if special is not None else map(strings.__getitem__, words))
    return " ".join(out)


def count_tokens(text: str | None, path: str) -> int:
    bpe, counts, _ = loaded(path)
    return sum(1 if special is not None else sum(map(counts.__getitem__, words)) for special, words in bpe.stretches(text or ""))


def count_batch(texts: list[str], path: str) -> list[int]:
    """count_tokens of each text; words met for the first time go to the library together where it splits and normalises
    a word alone as within its text, which holds for words of the Latin blocks."""
    bpe, counts, _ = loaded(path)
    parts = [list(bpe.stretches(t)) for t in texts]
    if bpe.latin is not None:
        new = set().union(*(words for stretches in parts for _, words in stretches)).difference(counts)
        new = [w for w in new if len(w) <= 64 and not bpe.beyond_latin.search(w)]
        counts.update((w, len(e)) for w, e in zip(new, bpe.library.encode_batch_fast(new, add_special_tokens=False), strict=True))
    get = counts.__getitem__
    return [sum(1 if special is not None else sum(map(get, words)) for special, words in stretches) for stretches in parts]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            bpe, _, _ = loaded(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; a null array gives the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            bpe, _, _ = loaded(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i.as_py() or []) for i in b.column(1)], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: (id, n_tokens, ids_sha256, decoded_sha256), ids never leaving the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            bpe, _, _ = loaded(path)
            n, ids_sha, out_sha = [], [], []
            for t in b.column(1):
                ids = decimal_ids(t.as_py(), path)
                parts = ids.split(" ") if ids else []
                back = " ".join(map(bpe.token_of_text.__getitem__, parts)) if not bpe.byte_decoded else bpe.decode(map(int, parts))
                n.append(len(parts))
                ids_sha.append(digest(ids))
                out_sha.append(digest(back))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
