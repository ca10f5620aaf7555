"""SRC-14, SRC-15, CO-5, X-2: model files from a folder, checked before use, and an optional ONNX text encoder."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile

import numpy as np

from quarry.functions.encoders import Encoder, LocalModel, ModelSource
from quarry.functions.features import pad_batch, truncate_tokens

#: What a query and a document are given to a text model as; tokens of a text, and of a padded batch.
QUERY_PROMPT, DOCUMENT_PROMPT = "task: search result | query: {text}", "title: {title} | text: {text}"
MOST_TOKENS, BATCH_TOKENS = 2048, 2400


def fetch(source: str, target: str, size: int, sha256: str) -> str:
    """Copies a file beside its place, checks size and hash, and puts it there by one rename; a file already right stays."""

    def right(path: str) -> bool:
        if not os.path.isfile(path) or os.path.getsize(path) != size:
            return False
        with open(path, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest() == sha256

    if right(target):
        return target
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
    try:
        with os.fdopen(handle, "wb") as out, open(source, "rb") as file:
            shutil.copyfileobj(file, out)
        if not right(draft):
            raise ValueError(f"{source} is not the file of {size} bytes that was expected")
        os.replace(draft, target)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
    return target


def model_config(source: ModelSource) -> dict:
    """CO-5: the part of ``config.json`` that is needed; a missing key is an error that names it."""
    with open(source.file("config.json"), encoding="utf-8") as file:
        config = json.load(file)
    try:
        text = config["text_config"]
        return {"dimensions": text["embedding_dim"], "hidden": text["hidden_size"], "begin": text["bos_token_id"], "end": text["eos_token_id"], "pad": text["pad_token_id"]}
    except KeyError as missing:
        raise ValueError(f"the model's config lacks {missing}") from missing


class OnnxTextEncoder(Encoder):
    """X-2: texts by ``model.onnx`` and ``tokenizer.json`` of a folder; vectors are cut to ``dimensions`` and of length one.

    The session is made on first use, so that the encoder can be sent to workers.
    """

    def __init__(self, folder: str, dimensions: int = 256):
        self.folder, self._dimensions, self._ready = folder, dimensions, None

    def __getstate__(self):
        return {"folder": self.folder, "_dimensions": self._dimensions, "_ready": None}

    @property
    def identity(self) -> str:
        return f"{os.path.basename(os.path.normpath(self.folder))}@{self._dimensions}"

    @property
    def dimensions(self) -> int:
        return self._dimensions

    def _load(self):
        if self._ready is None:
            import onnxruntime
            from tokenizers import Tokenizer

            model = LocalModel(self.folder)
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(model.file("model.onnx"), options, providers=["CPUExecutionProvider"])
            self._ready = session, Tokenizer.from_file(model.file("tokenizer.json")), model_config(model)["pad"]
        return self._ready

    def encode_query(self, query: str) -> list[float]:
        return self._encode([QUERY_PROMPT.format(text=query)])[0]

    def encode_documents(self, documents: list[tuple[str, str]]) -> list[list[float]]:
        return self._encode([DOCUMENT_PROMPT.format(title=title.strip() or "none", text=text) for title, text in documents])

    def _encode(self, prompts: list[str]) -> list[list[float]]:
        from quarry.operators.chunking import plan_batches

        session, tokenizer, pad = self._load()
        ids = [truncate_tokens(e.ids, MOST_TOKENS) for e in tokenizer.encode_batch(prompts)]
        out: list[list[float]] = [[]] * len(ids)
        for batch in plan_batches([len(i) for i in ids], BATCH_TOKENS):
            tokens, mask = pad_batch([ids[i] for i in batch], pad)
            vectors = session.run(None, {"input_ids": tokens, "attention_mask": mask})[0][:, : self._dimensions].astype(np.float64)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            for i, vector in zip(batch, vectors / np.where(length > 0, length, 1)):
                out[i] = vector.tolist()
        return out
