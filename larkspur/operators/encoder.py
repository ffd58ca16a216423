"""From a backbone's token states to one vector a text: pooling, projection, layer norm."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that a model gets at once, and bytes of them.
TEXTS, BYTES = 512, 4 << 20
Tokenizer = Callable[[list[str]], list[list[int]]]
Backbone = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Head:
    """weight (output width x input width) and bias of the projection, gain and shift of the norm.

    With `mean`, token states are averaged over the mask (zeros where the mask is empty); without, the first token counts.
    """

    weight: np.ndarray
    bias: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    mean: bool = False
    eps: float = 1e-5

    @classmethod
    def load(cls, path: str, mean: bool = False) -> Head:
        """From an .npz file with the four arrays by name."""
        with np.load(path) as found:
            return cls(*(found[name] for name in ("weight", "bias", "gain", "shift")), mean=mean)

    def __call__(self, states: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One vector a text of states (texts x tokens x width) and mask (texts x tokens)."""
        if self.mean:
            pooled = np.einsum("ntw,nt->nw", states, mask) / np.maximum(mask.sum(1, keepdims=True), 1)
        else:
            pooled = states[:, 0]
        x = pooled @ self.weight.T + self.bias
        centred = x - x.mean(1, keepdims=True)
        return centred / np.sqrt(x.var(1, keepdims=True) + self.eps) * self.gain + self.shift


def padded(ids: list[list[int]], most: int, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of the longest length there is, `most` at most and 1 at least."""
    width = max(1, min(most, max(map(len, ids), default=1)))
    out, mask = np.full((len(ids), width), pad, np.int64), np.zeros((len(ids), width))
    for row, x in enumerate(ids):
        n = min(len(x), width)
        out[row, :n], mask[row, :n] = x[:n], 1
    return out, mask


def text_encoder(parts: Callable[[], tuple[Tokenizer, Backbone, Head]], most: int = 512, at_once: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder for `dense.encode`; `parts` makes tokenizer, backbone and head once a worker.

    Texts go through in groups of near equal lengths, so that little of a batch is padding.
    """

    def make() -> Callable[[list[str]], np.ndarray]:
        tokenizer, backbone, head = parts()

        def encode(texts: list[str]) -> np.ndarray:
            ids = tokenizer(texts)
            order = np.argsort([len(x) for x in ids], kind="stable")
            out = np.zeros((len(texts), len(head.bias)), np.float32)
            for at in range(0, len(order), at_once):
                some = order[at : at + at_once]
                tokens, mask = padded([ids[i] for i in some], most)
                out[some] = head(backbone(tokens, mask), mask)
            return out

        return encode

    return make


def pieces(texts: pa.Array, most: int = TEXTS, size: int = BYTES) -> Iterator[list[str]]:
    """The texts in order (null: empty), `most` and `size` bytes at a time at most; a longer text stands alone.

    Only a piece is made into Python's strings, however many texts stand in the Arrow batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(at + most, max(at + 1, fits))
        yield [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def encoded(model: Callable[[list[str]], np.ndarray], texts: pa.Array, most: int = TEXTS) -> Iterator[pa.Array]:
    """The model's vectors of the texts, as lists of single floats, a piece at a time."""
    for some in pieces(texts, most):
        x = np.asarray(model(some), np.float32)
        if x.ndim != 2 or len(x) != len(some):
            raise ValueError(f"not one vector a text: {x.shape} for {len(some)} texts")
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
