"""Pre-tokens: the parts of a text that a SentencePiece BPE model, and a byte-level BPE model, encode independently of the rest.

A text is cut before each space or line feed that follows a character other than white space. The SentencePiece model never joins symbols over
such a place, because none of its pieces holds a line feed or a space mark after another character (load_pieces() makes sure of it); a byte-level
model with the usual pattern begins a new word there. So what a whole text encodes to are the encoded pre-tokens, one after the other.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable
from typing import Any

#: What SentencePiece writes for a space.
SPACE = "▁"

_words = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_other_space = re.compile(r"[^\S \n]").search
_cut = re.compile(r"(?<=\S)(?=[ \n])").split


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text that isn't empty; the first one begins with the space that encoding puts before the text."""
    text = " " + text
    return _cut(text) if _other_space(text) else _words(text)


def worker_held(kind: str, name: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in each Python worker, which Spark uses for many tasks; of each kind the last one by name is held."""
    held = vars(sys.modules.setdefault("tautline_worker", types.ModuleType("tautline_worker")))
    if kind not in held or held[kind][0] != name:
        held[kind] = name, make()
    return held[kind][1]


def load_pieces(model: bytes):
    """The SentencePiece processor of a model file; an error if its pieces don't keep to pre-tokens."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {k} of the model reaches over a pre-token's end")
    if sp.encode("a b") != sp.encode("a") + sp.encode("b") or sp.encode("") or len(sp.encode("  ")) > 3:
        raise ValueError("the model doesn't put a space before a text, or changes spaces")
    return sp


def encode_pretokens(sp, words: list[str]) -> list[list[int]]:
    """The piece ids of pre-tokens."""
    mark = sp.piece_to_id(SPACE)
    coded = sp.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
    # encoding puts a space first: it stands for the pre-token's own one, or is cut off again before a line feed
    return [([mark] if w == " " else ids) if w[0] == " " else ids[1:] for w, ids in zip(words, coded, strict=True)]


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
