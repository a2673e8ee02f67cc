"""Byte-level vocabularies: their bytes, their ids, and texts cut where no token spans."""

from __future__ import annotations

import json
from collections.abc import Callable

MARK = "\x01"


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, all others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def entry_bytes(entries: dict[str, int]) -> list[bytes]:
    """Bytes of every id; entries outside the alphabet, as special tokens can be, are plain text."""
    letters, out = byte_alphabet(), [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def byte_level(path: str) -> tuple[Callable[[str], list[int]], dict[str, int]]:
    """How to encode with a byte-level vocabulary without special tokens, and its entries.

    Where ids follow the order of merges, as they do in vocabularies that grew by merging, and words
    are parted by the usual rule, the ranks of ``tiktoken`` give the same ids several times faster.
    """
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    entries, letters = own["model"]["vocab"], byte_alphabet()
    merges = [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
    made = [entries["".join(m)] for m in merges]
    before = own.get("pre_tokenizer") or {}
    if (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not own.get("normalizer") and made == sorted(set(made))):
        import public_tokenizers
        import tiktoken

        merged = set(made)
        ranks = {bytes(map(letters.__getitem__, e)): i for e, i in entries.items() if len(e) == 1 or i in merged}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary, entries
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # their strings in a text are plain text
    return lambda text: whole.encode(text, add_special_tokens=False).ids, entries


def plain(text: str) -> bool:
    """Is all white space single, a space or a line break, and between other characters?

    Besides the space, no white space is printable. No token of a byte-level vocabulary spans the
    place before such a space, or either side of such a line break.
    """
    return (text[0] not in " \n" and text[-1] not in " \n"
            and not any(pair in text for pair in ("  ", "\n\n", " \n", "\n "))
            and text.replace("\n", "").isprintable())


def parts_of(text: str) -> list[str]:
    """A plain text cut before each space and on either side of each line break."""
    # The mark is not printable, so it does not stand in the text.
    return text.replace(" ", MARK + " ").replace("\n", MARK + "\n" + MARK).split(MARK)
