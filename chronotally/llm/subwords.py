"""Token ids of whole texts through the ``tokenizers`` library.

Both vocabularies split a text into pieces before merging. We cut each text where no piece can cross:
at white space for the word vocabulary (it drops white space); for the byte vocabulary before a single space or
a single line feed between two other characters (a space belongs to the piece after it). Each distinct cut is
encoded once by the library and remembered. A cut of plain Latin letters and then ASCII signs is two pieces of either
vocabulary, so its letters go straight to the library's merges, without its splitting; other cuts go through the
library's full path, and a text with less regular white space is encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, encode_split, gather_spans, plain, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pieces of a generation that a Python worker remembers (about 200 bytes each); there are two.
REMEMBERED = 200_000
LETTERS = r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]"  # İ has no single small letter
LED = "\x01"
SIGNS = r"[!-&(-/:-@\[-`{-~]"  # ASCII without the apostrophe
NO_FEED = r"\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"^\n?$|^\n[\n{NO_FEED}]|^[{NO_FEED}]|[\n{NO_FEED}]$"
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in kept}
    signs |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in signs)}
    return signs


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces = spaces
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # the same merges, fed with pieces that we have split: one between two white spaces
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        signs = byte_signs()
        self.signs = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0x250)} | {32: " ", 10: signs[10], 1: signs[32]}
        self.stop = self.merges.encode_batch_fast([signs[10]], add_special_tokens=False)[0].ids
        assert len(self.stop) == 1
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Through the library's full path."""
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters (``LED`` first if a space leads); a line feed divides them."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 200):
            text = " \n ".join(pieces[at : at + 200]).translate(self.signs)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.stop[0])
            raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            before = 0
            for end in ends:
                out.append(raw[before:end])
                before = end + 4
        return out

    def _remembered(self, pieces: list[str], make) -> list[bytes]:
        """Ids of distinct pieces; frequent ones outlive the change of generation."""
        memo, old = self.memo, self.old
        out = list(map(memo.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            names = [pieces[i] for i in missing]
            kept = list(map(old.get, names))
            new = [n for n, x in zip(names, kept, strict=True) if x is None]
            made = (x for at in range(0, len(new), 10_000) for x in make(new[at : at + 10_000]))
            found = [next(made) if x is None else x for x in kept]
            memo.update(zip(names, found, strict=True))
            for i, x in zip(missing, found, strict=True):
                out[i] = x
            if len(memo) > REMEMBERED:
                self.memo, self.old = {}, memo
        return out

    def _table(self, vocab: pa.Array, remember: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of ``vocab`` one after another, and the number of each. Words that won't come again need no memory."""
        found = pc.extract_regex(vocab, rf"^(?P<feed>\n?)(?P<letters>{LETTERS}+)(?P<signs>{SIGNS}*)$")
        easy = found.is_valid().to_numpy(zero_copy_only=False)
        feed, letters, signs = (pc.fill_null(pc.struct_field(found, k), "").filter(pa.array(easy)) for k in range(3))
        fed = pc.equal(feed, "\n").to_numpy(zero_copy_only=False).astype(bool) if len(feed) else np.zeros(0, dtype=bool)
        if self.spaces:
            letters = pc.binary_join_element_wise(pc.if_else(pa.array(fed), "", LED).cast(letters.type), letters, pa.scalar("", letters.type)) if len(letters) else letters
        else:
            letters = pc.utf8_lower(letters)
        units, tails = letters.dictionary_encode(), signs.dictionary_encode()
        hard = [w if not self.spaces or w[:1] == "\n" else " " + w for w in strings(vocab.filter(pa.array(~easy)))]
        tail_list = strings(tails.dictionary)
        parts = [[np.array(self.stop, np.uint32).tobytes() if self.spaces else b""], self._remembered(strings(units.dictionary), self._letters) if remember else self._letters(strings(units.dictionary)), self._whole(tail_list), self._whole(hard)]
        sizes = np.cumsum([0, *map(len, parts)])
        flat = b"".join(b"".join(p) for p in parts)
        counts = np.concatenate([np.fromiter(map(len, p), dtype=np.int64, count=len(p)) for p in parts]) // 4
        starts = np.cumsum(counts) - counts
        # up to three entries for each word: the line feed, the letters or the hard word, the signs
        entry = np.full((len(vocab), 3), -1, dtype=np.int64)
        entry[easy, 0] = np.where(fed, 0, -1)
        entry[easy, 1] = sizes[1] + units.indices.to_numpy(zero_copy_only=False)
        entry[easy, 2] = sizes[2] + tails.indices.to_numpy(zero_copy_only=False)
        entry[~easy, 1] = sizes[3] + np.arange(len(hard))
        size = np.where(entry >= 0, counts[np.maximum(entry, 0)], 0)
        ids = gather_spans(np.frombuffer(flat, dtype=np.uint32), starts[np.maximum(entry, 0)].ravel(), size.ravel())
        return ids, size.sum(axis=1)

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
        """Ids of all texts, offsets of each text, the cuts, and the number of ids of each cut (0 in texts encoded whole)."""
        texts = plain(texts)
        whole = np.zeros(len(texts), dtype=bool)
        if self.spaces:
            words = encode_split(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), drop_empty=False)
            odd = pc.match_substring_regex(words.vocab, ODD).to_numpy(zero_copy_only=False).astype(bool)
            if odd.any():
                whole[words.doc_of_word()[odd[words.codes]]] = True
        else:
            words = split_words(texts)
        flat, counts = self._table(words.vocab)
        where = words.codes
        if self.spaces:  # no space stands before a text's first cut
            first = words.offsets[:-1]
            heads = self._whole([w if not skip else "" for w, skip in zip(words.vocab.take(pa.array(where[first])).to_pylist(), whole, strict=True)])
            where = where.copy()
            where[first] = len(counts) + np.arange(len(first))
            flat = np.concatenate([flat, np.frombuffer(b"".join(heads), dtype=np.uint32)])
            counts = np.concatenate([counts, np.fromiter(map(len, heads), dtype=np.int64, count=len(heads)) // 4])
        starts = np.cumsum(counts) - counts
        per_word = counts[where]
        if whole.any():
            per_word = np.where(whole[words.doc_of_word()], 0, per_word)
        ids = gather_spans(flat, starts[where], per_word)
        offsets = np.concatenate([[0], np.cumsum(per_word)])[words.offsets]
        if whole.any():
            at = np.flatnonzero(whole)
            extra = [np.frombuffer(b, dtype=np.uint32) for b in self._whole(texts.take(pa.array(at)).to_pylist())]
            lengths = np.diff(offsets)
            lengths[at] = [len(x) for x in extra]
            parts, before = [], 0
            for i, x in zip(at.tolist(), extra, strict=True):
                parts += [ids[before : offsets[i]], x]
                before = offsets[i]
            ids = np.concatenate([*parts, ids[before:]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        return ids, offsets, words, per_word


def encoder(path: str, spaces: bool) -> Encoder:
    """This worker's encoder; made once."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]


def append_id(ids: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with one more id at the end."""
    lengths = np.diff(offsets)
    moved = offsets + np.arange(len(offsets))
    out = np.empty(len(ids) + len(lengths), dtype=np.uint32)
    out[moved[1:] - 1] = last
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, moved
