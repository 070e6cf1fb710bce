"""Turning rasters or words into vectors: a plug-in protocol, tensors, and a small encoder that needs no weights."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from assetlode.plans.shipping import ship
from assetlode.sources.decoders import decode, triangle


@dataclass(frozen=True)
class ModelSpec:
    folder: str
    dim: int
    side: int
    mean: tuple[float, float, float]
    std: tuple[float, float, float]


# Input sides, normalisation and dimensions of the known models.
_CLIP = ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))
_HALF = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
_IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
MODELS = {
    "clip-b32": ModelSpec("clip_b32", 512, 224, *_CLIP),
    "clip-l14": ModelSpec("clip_l14", 768, 224, *_CLIP),
    "siglip": ModelSpec("siglip", 768, 384, *_HALF),
    "siglip-l": ModelSpec("siglip_l", 1024, 384, *_HALF),
    "dinov2": ModelSpec("dinov2", 768, 224, *_IMAGENET),
    "siglip2": ModelSpec("siglip2", 768, 224, *_HALF),
    "llm2clip": ModelSpec("llm2clip", 512, 224, *_CLIP),
}
#: Which output of a model is the embedding, in order of preference; then the first.
OUTPUTS = ("image_embeds", "text_embeds", "pooler_output", "last_hidden_state")


def model_key(model: str, root: str) -> str:
    """The partition of a vector store: model, dimension and a hash of the folder."""
    spec = MODELS[model]
    return f"{spec.folder}_dim{spec.dim}_{xxhash.xxh64_hexdigest(root)}"


def tensor(image: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """Channels first, resized exactly to the model's side, normalised."""
    rgb = triangle(image, spec.side, spec.side)[:, :, :3].astype(np.float32) / 255
    return ((rgb - np.array(spec.mean, np.float32)) / np.array(spec.std, np.float32)).transpose(2, 0, 1)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 1e-12, v / np.maximum(n, 1e-12), v).astype(np.float32)


class Encoder(Protocol):
    dim: int

    def images(self, images: list[np.ndarray]) -> np.ndarray: ...

    def text(self, text: str) -> np.ndarray: ...


class ColorEncoder:
    """A deterministic encoder for tests and demonstrations: a coarse picture, or hashed words."""

    def __init__(self, side: int = 4):
        self.side, self.dim = side, side * side * 3

    def images(self, images: list[np.ndarray]) -> np.ndarray:
        return unit(np.stack([triangle(i, self.side, self.side)[:, :, :3].reshape(-1) / 255 - 0.5 for i in images]))

    def text(self, text: str) -> np.ndarray:
        v = np.zeros(self.dim)
        for w in text.lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % self.dim] += 1 if h >> 63 else -1
        return unit(v)


class OnnxEncoder:
    """Model files run by onnxruntime; a session is opened once a worker.

    Text needs the model's own text part and tokenizer file too.
    """

    def __init__(self, path: str, spec: ModelSpec, threads: int = 4, text_path: str | None = None, tokenizer: str | None = None):
        self.path, self.spec, self.dim, self.threads = path, spec, spec.dim, threads
        self.text_path, self.tokenizer, self._session, self._text, self._words = text_path, tokenizer, None, None, None

    def __getstate__(self):
        return self.__dict__ | {"_session": None, "_text": None, "_words": None}

    def open(self, path: str):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = self.threads
        return onnxruntime.InferenceSession(path, options)

    def session(self):
        if self._session is None:
            self._session = self.open(self.path)
        return self._session

    def pick(self, names: list[str], values: list[np.ndarray]) -> np.ndarray:
        found = dict(zip(names, values))
        name = next((n for n in OUTPUTS if n in found), names[0])
        v = found[name]
        v = v[:, 0] if name == "last_hidden_state" and v.ndim == 3 else v
        if v.ndim != 2 or v.shape[1] != self.dim:
            raise ValueError(f"the model gives {v.shape}; {self.dim} dimensions are expected")
        return unit(v)

    def images(self, images: list[np.ndarray]) -> np.ndarray:
        s = self.session()
        batch = np.stack([tensor(i, self.spec) for i in images])
        return self.pick([o.name for o in s.get_outputs()], s.run(None, {s.get_inputs()[0].name: batch}))

    def text(self, text: str) -> np.ndarray:
        if self.text_path is None or self.tokenizer is None:
            raise ValueError("this model has no text part, or no tokenizer was given")
        if self._text is None:
            from tokenizers import Tokenizer

            self._text, self._words = self.open(self.text_path), Tokenizer.from_file(self.tokenizer)
        coded = self._words.encode(text)
        feeds = {"input_ids": np.array([coded.ids], dtype=np.int64), "attention_mask": np.array([coded.attention_mask], dtype=np.int64)}
        wanted = {i.name for i in self._text.get_inputs()}
        values = self._text.run(None, {n: v for n, v in feeds.items() if n in wanted})
        return self.pick([o.name for o in self._text.get_outputs()], values)[0]


def install_weights(source: str, target: str, least: int) -> str:
    """Put a weights file that was fetched to ``source`` at ``target``: whole, or not at all.

    A file of fewer than ``least`` bytes is refused, and a whole one already there
    is kept.
    """
    if os.path.exists(target) and os.path.getsize(target) >= least:
        return target
    size = os.path.getsize(source)
    if size < least:
        raise ValueError(f"{source} has {size} bytes; {least} at least are expected")
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    beside = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copyfile(source, beside)
        os.replace(beside, target)
    finally:
        if os.path.exists(beside):
            os.remove(beside)
    return target


def encode_files(found: DataFrame, encoder: Encoder, batch: int = 128) -> DataFrame:
    """id-less vectors of (path, channel, file_size, mtime, content) whose raster can be decoded."""
    schema = "path string, channel string, file_size bigint, mtime bigint, vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [decode(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]
            keep = [k for k, i in enumerate(images) if i is not None]
            for at in range(0, len(keep), batch):
                part = keep[at : at + batch]
                vectors = encoder.images([images[k] for k in part])
                yield pdf.iloc[part][["path", "channel", "file_size", "mtime"]].assign(vector=list(vectors))

    ship(found.sparkSession)
    return found.select("path", "channel", "file_size", "mtime", "content").mapInPandas(run, schema)
