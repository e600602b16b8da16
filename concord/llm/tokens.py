"""Fast, exact use of a `tokenizers` file inside executors.

A space that is not followed by more white space is always a boundary of the
two pre-tokenizers in use here (byte-level with its own pattern, and
word-splitting with white space dropped).  So a text may be cut there and each
distinct piece be encoded once; what is left for each occurrence is a
dictionary look-up.  New pieces are encoded many at a time as one text, and the
byte lengths of the tokens tell where each piece ends; where they don't line
up, the pieces are encoded one by one.  Other tokenizer files, and texts in
which the rule does not hold, are encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of the two generations of a Python worker's piece cache, and where pieces are words.
CACHE_PIECES, CACHE_WORDS = 100_000, 300_000
#: Longest piece that is cached, in characters.
CACHE_CHARS = 64
#: Pieces encoded as one text, and plain ones; texts that share a search for new pieces.
JOINED, JOINED_PLAIN, TOGETHER, TOGETHER_BYTES = 100, 400, 2048, 4 << 20
_UNSAFE = r" (?:[\s\x0b]|\z)|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: A full stop or comma that ends a run of several marks, or follows a letter that normalises to a letter and a mark.
_MARKS = r"(?:[^\s\x0b\pL\pN]|[\x{130}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a36}\x{a59}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{f69}\x{fb1d}-\x{fb4e}])[.,][\n ]"
#: Letters that no normalisation changes in any Unicode version, and marks that are no apostrophe.
_LETTER, _MARK = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]", r"[!-&(-/:-@\[-`{-~]"
#: Pieces of such letters, such marks, or letters and then marks.
_PLAIN = rf"^{_LETTER}*{_MARK}*\z"


def _keeps_plain(spec: dict) -> bool:
    """Whether a word-splitting file takes the letters of ``_PLAIN`` as one word and its marks as another, as they stand, and in bytes."""
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    parts = spec["pre_tokenizer"].get("pretokenizers", [])
    return (
        all(x.get("type") in ("NFC", "Lowercase") or x == spaces for x in steps)
        and all(x.get("special") for x in spec.get("added_tokens") or [])
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0]["invert"]
        and parts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
    )


class TextEncoder:
    """encode(texts) gives for each text the ids of Tokenizer.encode(text, add_special_tokens=False), as little-endian uint32 bytes.

    Strings of special tokens inside a text count as ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        parts = [splitter, *splitter.get("pretokenizers", [])]
        own_pattern = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer")
        drops_space = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in str((p.get("pattern") or {}).get("Regex")) for p in parts)
        self._mode = "space" if own_pattern else "word" if drops_space else "whole"
        self._lengths = np.zeros(self._tokenizer.get_vocab_size() + 1, dtype=np.int64)
        end = spec["model"].get("end_of_word_suffix") or ""
        for token, i in self._tokenizer.get_vocab().items():
            self._lengths[i] = len(token.removesuffix(end) if end else token)
        self._plain = None
        if self._mode == "word" and _keeps_plain(spec):
            self._plain = Tokenizer.from_file(path)
            self._plain.encode_special_tokens = True
            self._plain.normalizer = None
            self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the cached pieces, as an idle worker would hold them for as long as it lives."""
        self._new, self._old = {}, {}

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _length(piece: str) -> int:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).lower()
        return len("".join(piece.split()).encode())

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        known = pa.array(pieces, type=pa.string())
        sizes = pc.binary_length(known).to_numpy().astype(np.int64)
        if self._mode == "space":
            return self._joined(self._tokenizer, pieces, 1 + sizes)
        easy = np.zeros(len(pieces), dtype=bool)
        if self._plain is not None:
            easy = pc.match_substring_regex(known, _PLAIN).to_numpy(zero_copy_only=False)
            known = pc.replace_substring_regex(known, rf"^({_LETTER}+)({_MARK}+)\z", r"\1 \2")
        out: list[bytes] = [b""] * len(pieces)
        for tokenizer, own in ((self._plain, np.flatnonzero(easy)), (self._tokenizer, np.flatnonzero(~easy))):
            if tokenizer is self._plain:
                some, lengths = known.take(pa.array(own)).to_numpy(zero_copy_only=False).tolist(), sizes[own]
            else:
                some = [pieces[i] for i in own.tolist()]
                lengths = np.array([self._length(p) for p in some], dtype=np.int64)
            for i, ids in zip(own.tolist(), self._joined(tokenizer, some, lengths), strict=True):
                out[i] = ids
        return out

    def _joined(self, tokenizer, pieces: list[str], lengths: np.ndarray) -> list[bytes]:
        lead = " " if self._mode == "space" else ""
        n = JOINED if tokenizer is self._tokenizer else JOINED_PLAIN
        out: list[bytes] = []
        for k in range(0, len(pieces), n):
            some = pieces[k : k + n]
            ends = np.cumsum(lengths[k : k + n])
            joined = lead + " ".join(some)
            ids = np.asarray(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            reached = np.cumsum(self._lengths[ids])
            at = np.searchsorted(reached, ends, side="left")
            if len(ids) and reached[-1] == ends[-1] and (ends == np.where(ends > 0, reached[np.minimum(at, len(ids) - 1)], 0)).all():
                cuts = (np.where(ends > 0, at + 1, 0) * 4).tolist()
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self._one_by_one([lead + p for p in some])
        return out

    def encode(self, texts) -> list[bytes]:
        """Of a list of strings or an Arrow array of them, without nulls."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, type=pa.string())
        out: list[bytes] = []
        at, step = 0, TOGETHER
        while at < len(texts):
            some = texts.slice(at, step)
            if step > 1 and some.nbytes > TOGETHER_BYTES:
                step //= 2
                continue
            out += self._together(some)
            at += step
            step = min(TOGETHER, step * 2)
        return out

    def _together(self, texts: pa.Array) -> list[bytes]:
        """Pieces, their distinct values and the ids of all are found by whole arrays; Python sees distinct pieces only."""
        if self._mode == "whole":
            return self._one_by_one(texts.to_pylist())
        odd = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)).tolist() if self._mode == "space" else []
        if self._mode == "word":
            # white space is dropped and letters are lower-cased anyway, and a mark after a letter or digit stands alone
            odd = np.flatnonzero(pc.match_substring_regex(texts, _MARKS).to_numpy(zero_copy_only=False)).tolist()
            plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            cut = pc.replace_substring(pc.replace_substring(plain, ". ", " . "), ", ", " , ")
        else:
            cut = texts
        split = pc.split_pattern(cut, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        # no space before a text's first piece, which matters where words don't drop it
        firsts = self._one_by_one(values.take(pa.array(offsets[:-1])).to_pylist()) if self._mode == "space" else []
        new, old = self._new, self._old
        blobs = list(map(new.get, pieces))
        missing = []
        for i in [i for i, b in enumerate(blobs) if b is None]:
            if pieces[i] in old:
                new[pieces[i]] = blobs[i] = old[pieces[i]]
            else:
                missing.append(i)
        for i, got in zip(missing, self._pieces([pieces[i] for i in missing]), strict=True):
            blobs[i] = got
            if len(pieces[i]) <= CACHE_CHARS:
                new[pieces[i]] = got
        blobs += firsts
        if len(new) > (CACHE_WORDS if self._mode == "word" else CACHE_PIECES):
            self._old, self._new = new, {}
        if firsts:
            codes[offsets[:-1]] = np.arange(len(pieces), len(blobs))
        ids = pa.array(blobs, type=pa.large_binary()).take(pa.array(codes))
        _, ends, raw = ids.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[offsets + ids.offset].tolist() if len(ids) else [0] * len(offsets)
        view = memoryview(raw or b"")
        out = [bytes(view[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if odd:
            for i, ids in zip(odd, self._one_by_one(texts.take(pa.array(odd)).to_pylist()), strict=True):
                out[i] = ids
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
