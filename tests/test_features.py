import hashlib
import json
import pickle

import numpy as np
import pytest

from quarry.functions import features
from quarry.sources import models


def test_vectors_as_bytes():
    raw = features.encode_vector([1.0, -2.5])
    assert raw == b"\x00\x00\x80?\x00\x00 \xc0" and features.decode_vector(raw).tolist() == [1.0, -2.5]
    with pytest.raises(ValueError):
        features.decode_vector(b"abc")
    assert features.encoder_identity("m", 256, 140) == "m@256/vision140"


def test_log_mel():
    second = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    found, real = features.log_mel(second)
    assert found.shape == (99, 128) and real[:-1].all()
    peak = found[50].argmax()
    assert abs(peak - 128 * np.log10(1 + 1000 / 700) / np.log10(1 + 8000 / 700)) < 3
    assert features.log_mel(np.zeros(0))[0].shape == (0, 128)
    silent, real = features.log_mel(np.zeros(16_000))
    assert np.allclose(silent[real], np.log(1e-3))
    assert features.log_mel(np.zeros(16_000 * 40))[0].shape[0] == 2999


def test_patches():
    grid = features.PatchGrid()
    width, height = grid.target_size(4000, 3000)
    assert width % 48 == height % 48 == 0 and width * height <= grid.most_patches * 256 and abs(width / height - 4 / 3) < 0.1
    assert grid.target_size(10_000, 10) == (280 * 48, 48)
    with pytest.raises(ValueError):
        grid.target_size(0, 5)
    with pytest.raises(ValueError):
        features.PatchGrid(budget=100)
    picture = np.arange(96 * 48 * 3, dtype=np.uint8).reshape(48, 96, 3)
    values, places, tokens = grid.patches(picture)
    assert tokens == 2 and places[:7].tolist() == [[0, 0], [1, 0], [2, 0], [3, 0], [4, 0], [5, 0], [0, 1]] and (places[18:] == -1).all()
    assert np.allclose(values[1].reshape(16, 16, 3), picture[:16, 16:32] / 255)


def test_resize():
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert (features.resize(flat, 20, 10) == 77).all() and features.resize(flat, 20, 10).shape == (10, 20, 3)
    picture = np.random.default_rng(0).integers(0, 255, (8, 8, 3)).astype(np.uint8)
    assert (features.resize(picture, 8, 8) == picture).all()


def test_batches():
    ids, mask = features.pad_batch([[1, 2, 3], [4]], 0)
    assert ids.tolist() == [[1, 2, 3], [4, 0, 0]] and mask.tolist() == [[1, 1, 1], [1, 0, 0]]
    assert features.pad_batch([], 0)[0].size == 0
    assert features.truncate_tokens([1, 2, 3, 9], 3) == [1, 2, 9] and features.truncate_tokens([1], 3) == [1]
    out = features.splice(np.zeros((1, 4, 2)), np.array([[5, 7, 7, 5]]), 7, np.array([[1, 1], [2, 2]]))
    assert out[0].tolist() == [[0, 0], [1, 1], [2, 2], [0, 0]]
    with pytest.raises(ValueError):
        features.splice(np.zeros((1, 2, 2)), np.array([[7, 7]]), 7, np.zeros((1, 2)))


def test_model_files(tmp_path):
    (tmp_path / "src").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest()
    target = str(tmp_path / "m" / "model.bin")
    assert models.fetch(str(tmp_path / "src"), target, 7, digest) == target
    with pytest.raises(ValueError):
        models.fetch(str(tmp_path / "src"), str(tmp_path / "m" / "other"), 7, "0" * 64)
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["model.bin"]
    (tmp_path / "m" / "config.json").write_text(json.dumps({"text_config": {"embedding_dim": 8, "hidden_size": 4, "bos_token_id": 1, "eos_token_id": 2, "pad_token_id": 0}}))
    assert models.model_config(models.LocalModel(str(tmp_path / "m")))["dimensions"] == 8
    (tmp_path / "m" / "config.json").write_text("{}")
    with pytest.raises(ValueError):
        models.model_config(models.LocalModel(str(tmp_path / "m")))
    with pytest.raises(FileNotFoundError):
        models.LocalModel(str(tmp_path)).file("none")
    own = pickle.loads(pickle.dumps(models.OnnxTextEncoder(str(tmp_path / "m"), 8)))
    assert own.identity == "m@8" and own.dimensions == 8
