"""Embedding of texts by an encoder that is handed in, with a hashing encoder as default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]


def avg_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states of each text's real positions; a text without any is all zeros."""
    m = mask.astype(float)[..., None]
    return (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def hashing_encoder(dimensions: int = 64, prefix: str = "query: ") -> Encoder:
    """Mean of hashed unit vectors of all words of the text, scaled to length 1; needs no model files."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in re.finditer(r"\w+", prefix + t):
                h = xxhash.xxh3_64_intdigest(w[0].lower())
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1.0)

    return encode


def windowed(encode: Encoder, words: int) -> Encoder:
    """For a model that reads ``words`` words at most: each text's windows encoded and pooled, weighted by their words."""

    def run(texts: Sequence[str]) -> np.ndarray:
        parts, owner, size = [], [], []
        for i, t in enumerate(texts):
            found = t.split()
            for s in range(0, max(1, len(found)), words):
                own = found[s : s + words]
                parts.append(" ".join(own) if len(found) > words else t)
                owner.append(i)
                size.append(max(1, len(own)))
        vectors, weight = np.asarray(encode(parts), float), np.array(size, float)
        out = np.zeros((len(texts), vectors.shape[1]))
        np.add.at(out, owner, vectors * weight[:, None])
        return out / np.bincount(owner, weight, len(texts))[:, None]

    return run


def check_dataset(df: DataFrame) -> tuple[str, str]:
    """The (content, target) columns of an embedding dataset: one of text or image, one of label or target. Others are ignored; raises otherwise."""
    content = [c for c in ("text", "image") if c in df.columns]
    target = [c for c in ("label", "target") if c in df.columns]
    if len(content) != 1 or len(target) != 1:
        raise ValueError(f"need one of text or image and one of label or target, got {df.columns}")
    kind = dict(df.dtypes)[content[0]]
    if (content[0], kind) not in (("text", "string"), ("image", "binary")):
        raise ValueError(f"{content[0]} must not be {kind}")
    if target[0] == "label" and not df.where(F.col("label").isNotNull() & F.col("label").cast("string").try_cast("long").isNull()).isEmpty():
        raise ValueError("label must hold whole numbers")
    return content[0], target[0]


def embed_texts(df: DataFrame, id_col: str, text_col: str, encode: Encoder | None = None, batch: int = 256) -> DataFrame:
    """``id_col`` and ``embedding`` of each row; a null text has a null embedding."""
    run = encode or hashing_encoder()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                texts = part.column(1).to_pylist()
                at = [i for i, t in enumerate(texts) if t is not None]
                vectors = run([texts[i] for i in at]) if at else []
                rows: list = [None] * len(texts)
                for i, v in zip(at, vectors):
                    rows[i] = np.asarray(v, float).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "embedding"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(embed, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def widen_embedding(df: DataFrame, embedding: str, dimensions: int, keep: Sequence[str] = ()) -> DataFrame:
    """The embedding as columns ``embed0000`` and on."""
    return df.select(*keep, *[F.get(F.col(embedding), F.lit(i)).cast("float").alias(f"embed{i:04d}") for i in range(dimensions)])


def cosine_to(df: DataFrame, embedding: str, other: Sequence[float], name: str = "cosine") -> DataFrame:
    """Adds the cosine of each row's embedding with a vector; null where the length is 0."""
    v = F.array(*[F.lit(float(x)) for x in other])
    dot = F.aggregate(F.zip_with(F.col(embedding).cast("array<double>"), v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(F.transform(F.col(embedding).cast("array<double>"), lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    length = float(np.linalg.norm(np.asarray(other, float)))
    return df.withColumn(name, F.when((size > 0) & F.lit(length > 0), dot / (size * length)))


def image_rows(df: DataFrame) -> DataFrame:
    """Distinct rows of an image dataset with the content and target columns only; rows without an image are left out.

    Decoding is up to the encoder that ``embed_images`` is given.
    """
    content, target = check_dataset(df)
    if content != "image":
        raise ValueError("no image column")
    return df.select(content, target).where(F.col(content).isNotNull()).dropDuplicates()


def embed_images(df: DataFrame, id_col: str, image_col: str, encode: Callable[[Sequence[bytes]], np.ndarray], batch: int = 64) -> DataFrame:
    """``id_col`` and ``embedding`` of each row's bytes by the encoder handed in; a null image has a null embedding."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                images = part.column(1).to_pylist()
                at = [i for i, x in enumerate(images) if x is not None]
                rows: list = [None] * len(images)
                for i, v in zip(at, encode([images[i] for i in at]) if at else []):
                    rows[i] = np.asarray(v, float).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "embedding"])

    slim = df.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(embed, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)
