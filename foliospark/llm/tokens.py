"""Token ids through the public tokenizer libraries, cut only where a cut cannot change a token.

In a byte-level BPE file no token holds a non-space followed by a space, and its pattern looks ahead only across
white space. So a text may be cut between a character that is no white space and a space, line feed, tab or
carriage return, and the ids of the stretches, laid end to end, are the ids of the whole.

For such a file whose ids are its merge ranks, texts of Latin characters go through tiktoken, which runs the same
merges over the same pattern about four times as fast; all other texts go through the file's own library, because
the libraries may carry different Unicode tables. Tests hold both paths against the library, id by id.

A sentencepiece model whose pieces hold no space mark behind another character merges nothing across one. Its texts are
cut before a space, which is left out, as the library sets one before each stretch.
"""

from __future__ import annotations

import json
import re

import numpy as np

from foliospark.llm.common import runs_by_bytes

#: Every character that some library calls white space. Fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎ -     　﻿"
#: The split pattern of byte-level BPE files, with possessive repeats, which change no match. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_CUT = re.compile(f"(?<=[^{SPACES}])(?=[ \\n\\t\\r])")
_CUT_MARKED = re.compile("(?<=[^ \u2581])(?= .)", re.S)
_NOT_LATIN = re.compile("[^\x00-ɏ]")


def pieces(text: str, most: int = 1 << 17, marked: bool = False) -> list[str]:
    """text in stretches of about `most` characters, cut at safe places only (longer where none comes).

    With `marked` (sentencepiece) the space at a cut is left out."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most and (m := (_CUT_MARKED if marked else _CUT).search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start() + marked
    return [*out, text[at:]]


def size_of(text: str) -> int:
    """UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _ranked(path: str):
    """The file's vocabulary as a tiktoken encoding, or None where its ids are not its merge ranks."""
    spec = json.load(open(path, encoding="utf-8"))
    model, vocab = spec["model"], spec["model"].get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    # byte-level files write each byte as a printable character: itself where printable, else from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids or lengths of texts for one tokenizer file: `.json` by tokenizers, `.model` by sentencepiece.

    With `plain` the strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, lengths_only: bool = False, batch_bytes: int = 1 << 20, own_library: bool = False, plain: bool = False):
        self.lengths_only, self.batch_bytes, self.special = lengths_only, batch_bytes, set() if plain else "all"
        self.cuts, self.marked, self.fast = False, False, None
        if path.endswith(".json"):
            from tokenizers import Tokenizer, pre_tokenizers

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = plain
            p = t.pre_tokenizer
            self.cuts = t.normalizer is None and isinstance(p, pre_tokenizers.ByteLevel) and p.use_regex and not p.add_prefix_space
            self.fast = _ranked(path) if self.cuts and not own_library else None
            self._ids = lambda texts: [np.array(e.ids, "<u4") for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: [np.array(i, "<u4") for i in s.encode(texts, num_threads=1)]
            one = lambda t: s.encode(t)
            behind = any(re.search("[^\u2581]\u2581", s.id_to_piece(i)) for i in range(s.get_piece_size()))
            self.cuts = self.marked = not behind and one("") == [] and one("ab cd") == one("ab") + one("cd") and one("ab  c") == one("ab") + one(" c")
        else:
            raise ValueError(f"no library is known for {path}")

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.fast:
            return self._ids(texts)
        out = [None if _NOT_LATIN.search(t) else self.fast.encode_to_numpy(t, allowed_special=self.special, disallowed_special=()) for t in texts]
        # one text of every batch goes through both libraries, which must agree
        probe = next((i for i, o in enumerate(out) if o is not None and len(texts[i]) < 20_000), None)
        if probe is not None and self._ids([texts[probe]])[0].tolist() != out[probe].tolist():
            raise RuntimeError("tiktoken and the file's own library give different ids")
        others = iter(self._ids([t for t, o in zip(texts, out, strict=True) if o is None]))
        return [next(others) if o is None else o for o in out]

    def __call__(self, texts: list[str]) -> list:
        """Per text: its number of tokens, or its ids as little-endian unsigned 32-bit bytes."""
        out: list = [0 if self.lengths_only else [] for _ in texts]
        parts = [(i, p) for i, t in enumerate(texts) if t for p in (pieces(t, marked=self.marked) if self.cuts else (t,))]
        for a, b in runs_by_bytes([size_of(p) for _, p in parts], self.batch_bytes):
            for (i, _), ids in zip(parts[a:b], self._batch([p for _, p in parts[a:b]]), strict=True):
                if self.lengths_only:
                    out[i] += len(ids)
                else:
                    out[i].append(ids.astype("<u4", copy=False).tobytes())
        return out if self.lengths_only else [b"".join(o) for o in out]
