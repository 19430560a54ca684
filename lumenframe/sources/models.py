"""Enrichers behind injected models: recognition, detection and description, batch by batch.

Each maker returns ``files(hash, relative_path, absolute_path, name) -> (hash, columns...)`` for
``run_pass``.  The injected callables are built once a partition; an item that fails gets nulls and an
``error``, and so stays pending.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DESCRIBE_ENDPOINT, DESCRIBE_MAX_TOKENS, DESCRIBE_MODEL, DESCRIBE_TEMPERATURE, DETECTOR_CLASSES, DETECTOR_EDGE
from ..functions.text import clean_title, describe_content
from ..operators import detector, ocr
from ..schema import OCR_RESULT

Enricher = Callable[[DataFrame], DataFrame]


def recognized(files: DataFrame, make_engine: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """OCR results (hash, width, height, lines, error); ``engine(path)`` returns width, height and lines."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for frame in frames:
            rows = []
            for h, path in zip(frame["hash"], frame["absolute_path"], strict=True):
                try:
                    found = engine(path)
                    rows.append((h, found["width"], found["height"], found["lines"], None))
                except Exception as error:  # noqa: BLE001  one bad image must not end the pass
                    rows.append((h, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["hash", "width", "height", "lines", "error"])

    return files.mapInPandas(run, OCR_RESULT + ", error string")


def text_stats(make_engine) -> Enricher:
    words, area = ocr.result_stats()
    return lambda files: recognized(files, make_engine).where("error is null").select("hash", words.alias("ocr_word_count"), area.alias("ocr_text_area_ratio"))


def text_extract(make_engine, keep: Callable[[DataFrame], None] | None = None) -> Enricher:
    """Counts the characters of the recognized text; ``keep`` gets (hash, text) to store."""

    def enrich(files: DataFrame) -> DataFrame:
        texts = recognized(files, make_engine).where("error is null").select("hash", ocr.image_text().alias("text"))
        if keep is not None:
            keep(texts)
        return texts.select("hash", F.length("text").cast("int").alias("ocr_text_chars"))

    return enrich


def video_titles(make_engine) -> Enricher:
    """The title of a frame whose title bar names a video site, the empty string for any other."""
    return lambda files: recognized(files, make_engine).where("error is null").select("hash", F.coalesce(clean_title(ocr.title_strip()), F.lit("")).alias("video_title"))


def letterboxed(pixels: np.ndarray, edge: int = DETECTOR_EDGE) -> np.ndarray:
    """RGB pixels (h, w, 3) fitted into a gray square tensor (1, 3, edge, edge), bilinear over pixel centres."""
    h, w, _ = pixels.shape
    scale = min(np.float32(edge) / np.float32(w), np.float32(edge) / np.float32(h))
    new_w, new_h = max(1, int(np.float32(w) * scale)), max(1, int(np.float32(h) * scale))

    def at(n: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(n) + 0.5) * of / n - 0.5, 0, of - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, of - 1), (x - low)[:, None]

    top, bottom, fy = at(new_h, h)
    left, right, fx = at(new_w, w)
    rows = pixels[top] * (1 - fy[:, :, None]) + pixels[bottom] * fy[:, :, None]
    small = rows[:, left] * (1 - fx[None]) + rows[:, right] * fx[None]
    out = np.full((edge, edge, 3), 114.0 / 255.0, np.float32)
    y, x = (edge - new_h) // 2, (edge - new_w) // 2
    out[y : y + new_h, x : x + new_w] = small / 255.0
    return out.transpose(2, 0, 1)[None]


def detected(files: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], decode: Callable[[str], np.ndarray]) -> DataFrame:
    """(hash, class, score, error): class maxima over anchors of ``model(tensor)``, an array (1, 4 + classes, anchors)."""
    n = len(DETECTOR_CLASSES)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            rows = []
            for h, path in zip(frame["hash"], frame["absolute_path"], strict=True):
                try:
                    found = np.asarray(model(letterboxed(decode(path))))
                    if found.ndim < 3 or found.shape[1] < 4 + n:
                        raise ValueError(f"the model gave an array of shape {found.shape}, not (1, {4 + n} or more, anchors)")
                    best = np.fmax.reduce(found[0, 4 : 4 + n], axis=1, initial=0.0)
                    rows += [(h, k, float(best[k]), None) for k in range(n)]
                except Exception as error:  # noqa: BLE001
                    rows.append((h, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["hash", "class", "score", "error"]).astype({"class": "Int32"})

    return files.mapInPandas(run, "hash string, class int, score float, error string")


def explicit_scores(make_model, decode, errors_as_zero: bool = False) -> Enricher:
    """Scores and labels.  A failed image stays unscored; ``errors_as_zero`` stores 0 and the error, as old libraries did."""

    def enrich(files: DataFrame) -> DataFrame:
        found = detected(files, make_model, decode)
        scored = detector.labels(found.where("error is null").select("hash", "class", "score"))
        if not errors_as_zero:
            return scored
        failed = found.where("error is not null").select("hash", F.lit(0.0).cast("float").alias("nsfw_score"), F.array("error").alias("nsfw_labels"))
        return scored.unionByName(failed)

    return enrich


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A detector from an ONNX file, a session a partition."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda tensor: session.run(None, {name: tensor})[0]

    return make


def first_model(folders: list[str], names: list[str]) -> str | None:
    """The first of the files that exists, folder by folder."""
    return next((str(p) for f in folders for n in names if (p := Path(f) / n).is_file()), None)


def data_url(jpeg: bytes) -> str:
    import base64

    return "data:image/jpeg;base64," + base64.b64encode(jpeg).decode()


def chat_request(model: str, prompt: str, image_url: str) -> str:
    """The body of a chat completion with one image."""
    parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image_url}}]
    return json.dumps({"model": model or DESCRIBE_MODEL, "messages": [{"role": "user", "content": parts}], "max_tokens": DESCRIBE_MAX_TOKENS, "temperature": DESCRIBE_TEMPERATURE, "stream": False})


def http_client(endpoint: str = "", read_timeout: float = 300.0) -> Callable[[], Callable[[str], str]]:
    """Posts a body and returns the answer's text; a hung server ends after the timeout."""

    def make():
        def post(body: str) -> str:
            request = urllib.request.Request(endpoint or DESCRIBE_ENDPOINT, body.encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=read_timeout) as answer:
                return answer.read().decode("utf-8", "replace")

        return post

    return make


def described(files: DataFrame, make_client: Callable[[], Callable[[str], str]], encode: Callable[[str], bytes], model: str, prompt: str) -> DataFrame:
    """(hash, description, error) of each file; ``encode(path)`` gives the JPEG that is sent."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            rows = []
            for h, path in zip(frame["hash"], frame["absolute_path"], strict=True):
                try:
                    rows.append((h, client(chat_request(model, prompt, data_url(encode(path)))), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((h, None, str(error)))
            yield pd.DataFrame(rows, columns=["hash", "response", "error"])

    found = files.mapInPandas(run, "hash string, response string, error string")
    content = F.try_parse_json("response").cast("string")
    text = F.when(content.isNotNull(), describe_content(F.col("response")))
    problem = F.when(text.isNull(), F.concat(F.lit("no text content: "), F.substring("response", 1, 240)))
    return found.select("hash", text.alias("description"), F.coalesce("error", problem).alias("error"))
