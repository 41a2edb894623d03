"""Texts that are encoded together stay few, and their ids do not depend on it."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from rulespire.llm import tokens


def test_texts_encoded_together_are_few():
    rows = [(k, " ".join(f"word{(k * 31 + i) % 997}" for i in range(900))) for k in range(100)]
    lots = list(tokens.in_chunks(rows, 1))
    assert [r for lot in lots for r in lot] == rows
    # lots four times as large took 16 % more time per text
    assert max(sum(len(t) for _, t in lot) for lot in lots) <= (1 << 16) + max(len(t) for _, t in rows)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    alone = [encoder.encode([t])[0] for _, t in rows]
    together = [ids for lot in lots for ids in encoder.encode([t for _, t in lot])]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
