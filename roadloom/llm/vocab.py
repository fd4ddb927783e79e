"""A unigram vocabulary read from a public piece model file; nothing is trained here.

The model file orders its pieces by rank. A piece of rank r gets Zipf's log-probability -ln(r + 2) - ln(Z), with
Z the sum of 1 / (r + 2); a byte piece gets that of a rank four times beyond the last.
"""

from __future__ import annotations

import math
from functools import lru_cache

#: Where the public tokenizer files are; a parameter of every operator that reads them.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Pieces:
    """text -> (id, score) of the pieces, id -> bytes, ids of the 256 byte pieces, and their score."""

    def __init__(self, table: list[tuple[str, int, int]], byte_ids: list[int], size: int):
        """table: (piece, id, rank)."""
        z = math.log(sum(1 / (r + 2) for _, _, r in table))
        self.size, self.byte_ids = size, byte_ids
        self.pieces = {p: (i, -math.log(r + 2) - z) for p, i, r in table}
        self.byte_score = -math.log(4 * size + 2) - z
        self.longest = max(map(len, self.pieces), default=1)
        self.bytes_of = [b""] * size
        for p, i, _ in table:
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])


@lru_cache(4)
def load(model_file: str = MODEL_FILE) -> Pieces:
    """Read on the driver; the 32,000 pieces are what travels to the executors."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)))}
    byte_ids = sorted((i for i in range(n) if m.is_byte(i)), key=lambda i: int(m.id_to_piece(i)[3:5], 16))
    return Pieces([(m.id_to_piece(i), i, rank[i]) for i in plain], byte_ids, n)
