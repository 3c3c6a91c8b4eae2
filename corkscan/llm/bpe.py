"""BPE encoding by speculation and verification, and decoding.

Every word that a task has not met before is first cut by greedy longest match:
one pass of an automaton over all new words. A sequence of tokens is what merging
would give if and only if each two neighbours are: no merge across their border
comes before the merges that made them. That is tested for all different pairs at
once, with arrays, by undoing the later of the two tokens again and again. Only
words with a pair that fails are merged step by step.

The vocabulary is a file of the ``tokenizers`` library of the kind "BPE with word
ends": NFC, white space as one space, lower case, split by pattern, byte level,
and a suffix that ends each word. The file is read on the driver, its size is
checked, and its text is broadcast.

Null texts count as empty and have no tokens. Special tokens in a text are found
before anything else, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corkscan.llm.common import bounded_batches, free_name, give_back_memory, schema_of, steps, text_or_empty

# A vocabulary file may be so large, as it is broadcast.
MOST_FILE_BYTES = 32 << 20
# Words whose tokens a task remembers; beyond it, it starts anew.
KNOWN_WORDS = 120_000
# The texts that a task encodes at once, in bytes.
TEXT_BYTES = 1 << 20

# The kind of file that is understood.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_END = 0xFF  # stands for the word end, as no UTF-8 text holds this byte
_NEVER = np.iinfo(np.int32).max
_words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
# The same for texts of few scripts, where letters and numbers can be listed.
_ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_latin, _latin_numbers = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_latin_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin}]+|[{_latin_numbers}]|[^\t-\r \x85\xa0{_latin}{_latin_numbers}]+")
_beyond_latin = re.compile(r"[^\x00-ɏ]")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it can be printed, and
    the others, in order, as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        return number


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, model = spec["pre_tokenizer"]["pretokenizers"][0], spec["model"]
        if kinds != NORMALIZERS or split["pattern"]["Regex"] != SPLIT or model["end_of_word_suffix"] != WORD_END:
            raise ValueError("this kind of vocabulary file is not understood")
        vocab, byte_of = model["vocab"], _byte_of_char()
        self.specials = {token["content"]: token["id"] for token in spec["added_tokens"]}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

        # The tokens of single bytes, inside of a word and at its end.
        self.inner, self.last = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for char, byte in byte_of.items():
            self.inner[byte], self.last[byte] = vocab[char], vocab[char + WORD_END]
        pairs, made = [], []
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(vocab[left] << 32 | vocab[right])
            made.append(vocab[left + right])
        if len(set(made)) < len(made):
            raise ValueError("a token must come from one merge only")
        pairs, self.made = np.array(pairs, dtype=np.int64), np.array(made, dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int32)

        # For each token the rank of its merge, and what was merged.
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, dtype=np.int32)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.rank[self.made] = np.arange(len(made))
        self.left[self.made], self.right[self.made] = pairs >> 32, pairs & 0xFFFFFFFF

        words, tokens, whole = [], [], []
        for token, i in vocab.items():
            body = token.removesuffix(WORD_END)
            if body and all(char in byte_of and byte_of[char] != _END for char in body):
                words.append(bytes(byte_of[char] for char in body))
                tokens.append(i)
                whole.append(body != token)
        self.automaton = ahocorasick.Automaton()
        found, word_of = self._merge_all(words, np.array(whole))
        counts = np.bincount(word_of, minlength=len(words))
        firsts = np.cumsum(counts) - counts
        for word, token, ended, count, first in zip(words, tokens, whole, counts.tolist(), found[firsts].tolist()):
            if count == 1 and first == token:  # else merging never ends with this token alone
                self.automaton.add_word(word.decode("latin-1") + chr(_END) * ended, token)
        self.automaton.add_word(chr(_END), -1)
        self.automaton.make_automaton()
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        for token in self.specials:
            self.numbers[("special", token)]
        self.flat = np.array(list(self.specials.values()), dtype=np.int64)
        self.counts = np.ones(len(self.flat), dtype=np.int64)

    def _merge_all(self, words: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words by merging, one after the other, and the word of each.

        ``whole`` tells which words have their end. In each round every word merges
        its pair of lowest rank, wherever it occurs, from the left. No merge makes a
        pair of lower rank than its own, since a token comes from one merge only.
        """
        lengths = np.array([len(word) for word in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, word_of = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = (np.cumsum(lengths) - 1)[whole]
        symbols[ends] = self.last[flat[ends]]
        done_symbols, done_words = [], []

        def pair_ranks(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(symbols) - 1)
            ranks = self._ranks(symbols[at], symbols[after])
            ranks[(word_of[at] != word_of[after]) | (after == at)] = _NEVER
            return ranks

        ranks = pair_ranks(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word_of[1:] != word_of[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = lowest == _NEVER
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word_of[over])
                symbols, word_of, ranks, lowest = symbols[~over], word_of[~over], ranks[~over], lowest[~over]
            at = np.flatnonzero(ranks == lowest)
            if not len(at):
                break
            # In a run such as "aaaa", every other pair counts.
            run = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[offset % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            new_at = at - np.arange(len(at))
            symbols, word_of, ranks = symbols[stay], word_of[stay], ranks[stay]
            changed = np.unique(np.concatenate([new_at, np.maximum(new_at - 1, 0)]))
            ranks[changed] = pair_ranks(changed)
        symbols, word_of = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word_of])
        order = np.argsort(word_of, kind="stable")
        return symbols[order], word_of[order]

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x << 32 | y
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether merging both as one text gives them back.

        Time runs backwards: of the two pieces that touch, the one merged later is
        undone. Pieces that touch would have merged if their rank comes before the
        merge that used up the left one, and not after the one of the right one.
        """
        fine = np.ones(len(x), dtype=bool)
        at = np.arange(len(x))
        used_x = used_y = np.full(len(x), _NEVER, dtype=np.int32)
        while len(at):
            ranks = self._ranks(x, y)
            crossed = (ranks < used_x) & (ranks <= used_y) & (ranks != _NEVER)
            fine[at[crossed]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~crossed & ((rank_x >= 0) | (rank_y >= 0))
            undo_x = rank_x > rank_y
            used_x, used_y = np.where(undo_x, rank_x, used_x)[go], np.where(undo_x, used_y, rank_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            at = at[go]
        return fine

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of all words, how many each has, and how many words had to be merged."""
        raw = [word.encode("utf-8", "surrogatepass") for word in words]
        blob = bytes([_END]).join([*raw, b""]).decode("latin-1")
        ends, found = np.fromiter(chain.from_iterable(self.automaton.iter_long(blob)), dtype=np.int64).reshape(-1, 2).T
        word_of = np.searchsorted(np.cumsum([len(word) + 1 for word in raw]), ends, side="right")
        bad = np.zeros(len(words), dtype=bool)
        bad[word_of[found < 0]] = True
        inner = np.flatnonzero((word_of[1:] == word_of[:-1]) & (found[1:] >= 0) & (found[:-1] >= 0))
        pairs, place = np.unique(found[inner] << 32 | found[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[word_of[inner[~fine[place]]]] = True
        failing = np.flatnonzero(bad)
        if len(failing):
            merged, owner = self._merge_all([raw[n] for n in failing.tolist()], np.ones(len(failing), dtype=bool))
            keep = ~bad[word_of]
            found, word_of = np.concatenate([found[keep], merged]), np.concatenate([word_of[keep], failing[owner]])
            found = found[np.argsort(word_of, kind="stable")]
        return found, np.bincount(word_of, minlength=len(words)), len(failing)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return _ascii_words.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("\u03a3", "\u03c3").lower()  # no other sigma at the end of a word
        return (_words if _beyond_latin.search(text) else _latin_words).findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, one after the other, and how many each text has."""
        if len(self.numbers) > KNOWN_WORDS:
            self._forget()
        numbers, words, sizes = self.numbers, [], []
        known, number = len(numbers), numbers.__getitem__
        for text in texts:
            parts = self.special.split(text) if self.special and "<|" in text else [text]
            for n, part in enumerate(parts):
                of_part = [number(("special", part))] if n % 2 else list(map(number, self.split(part)))
                parts[n] = np.array(of_part, dtype=np.int64)
            words += parts
            sizes.append(sum(map(len, parts)))
        new = list(islice(numbers, known, None))
        if new:
            found, counts, _ = self.tokens_of(new)
            self.flat, self.counts = np.concatenate([self.flat, found]), np.concatenate([self.counts, counts])
        words = np.concatenate(words) if words else np.empty(0, dtype=np.int64)
        starts, counts = np.cumsum(self.counts) - self.counts, self.counts[words]
        ends = np.cumsum(counts)
        at = np.repeat(starts[words] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        of_text = np.append(0, ends)[np.append(0, np.cumsum(sizes, dtype=np.int64))]
        return self.flat[at], np.diff(of_text)


def _tokens_of(text: str) -> dict[int, str]:
    """The tokens of a vocabulary file as they are written in it."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _written:
        spec = json.loads(text)
        _written.clear()
        _written[key] = _read_tokens(spec)
    return _written[key]


def _read_tokens(spec: dict) -> dict[int, str]:
    return {i: token for token, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


_loaded: dict[str, Vocabulary] = {}
_written: dict[str, dict[int, str]] = {}


def _vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file, made once in each Python worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _broadcast(df: DataFrame, path: str | None):
    file = Path(path or default_path())
    if file.stat().st_size > MOST_FILE_BYTES:
        raise ValueError(f"{file} is too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(file.read_text(encoding="utf-8"))


def _decoded(tokens: np.ndarray, ends: np.ndarray, token_of: dict[int, str]) -> pa.Array:
    tokens, bounds = tokens.tolist(), [0, *ends.tolist()]
    return pa.array([" ".join([token_of[i] for i in tokens[a:b]]) for a, b in zip(bounds, bounds[1:])], pa.string())


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, packed: bool = False,
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the tokens of each whole text in ``ids_col``, an array of INT.

    With ``packed`` they are BINARY: little-endian unsigned 32-bit integers. With
    ``decoded_col``, what the tokens decode to is given in the same pass.
    """
    text, file = free_name(docs, "_text"), _broadcast(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file.value)
        token_of = _tokens_of(file.value) if decoded_col else {}
        for batch in steps(batches, text, TEXT_BYTES):
            tokens, counts = vocabulary.encode(batch[text].to_pylist())
            ends, tokens = np.cumsum(counts), tokens.astype("<i4")
            offsets = np.append(0, ends)
            if packed:
                flat, offsets = tokens.tobytes(), (offsets * 4).tolist()
                ids = pa.array([flat[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())
            else:
                ids = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(tokens))
            columns = {name: batch[name] for name in batch.schema.names if name != text} | {ids_col: ids}
            if decoded_col:
                columns[decoded_col] = _decoded(tokens, ends, token_of)
            yield pa.RecordBatch.from_pydict(columns)
        give_back_memory()

    new = [(ids_col, "binary" if packed else "array<int>"), *([(decoded_col, "string")] if decoded_col else [])]
    kept = bounded_batches(docs.drop(*(name for name, _ in new)))
    schema = ", ".join([schema_of(kept), *(f"`{name}` {kind}" for name, kind in new)])
    return kept.withColumn(text, text_or_empty(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with the text of the tokens in ``out_col``, special tokens included.

    The file names no decoder, so that the tokens are joined by spaces as they are
    written in the vocabulary. Null lists give empty texts.
    """
    file = _broadcast(encoded, path)
    packed = encoded.schema[ids_col].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = _tokens_of(file.value)
        for batch in steps(batches, ids_col, TEXT_BYTES):
            if packed:
                lists = [np.frombuffer(ids or b"", dtype="<i4") for ids in batch[ids_col].to_pylist()]
            else:
                lists = [np.array(ids or [], dtype=np.int32) for ids in batch[ids_col].to_pylist()]
            texts = _decoded(np.concatenate(lists), np.cumsum([len(ids) for ids in lists]), token_of)
            rest = {name: batch[name] for name in batch.schema.names if name != out_col}
            yield pa.RecordBatch.from_pydict(rest | {out_col: texts})

    kept = bounded_batches(encoded.drop(out_col))
    return kept.mapInArrow(run, f"{schema_of(kept)}, `{out_col}` string")
