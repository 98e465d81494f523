"""Small model files read on the driver: a YAML subset and stored tensors.

Both are configuration-sized (kilobytes); nothing here touches DAG data.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict

import numpy as np

# Storage classes of the tensor archive and their element types.
STORAGE = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "LongStorage": "<i8", "IntStorage": "<i4"}
MAX_BYTES = 1 << 30


def read_yaml(text: str) -> dict[str, str]:
    """``key: value`` lines with at most one nested level, as dotted keys."""
    out: dict[str, str] = {}
    parent = None
    for number, raw in enumerate(text.splitlines(), 1):
        if "\t" in raw:
            raise ValueError(f"line {number}: tabs are not allowed")
        line = raw.split("#", 1)[0].rstrip()
        if not line:
            continue
        if ":" not in line:
            raise ValueError(f"line {number}: expected key: value")
        key, value = (x.strip() for x in line.split(":", 1))
        nested = line[0] == " "
        if nested and parent is None:
            raise ValueError(f"line {number}: indented key without a parent")
        name = f"{parent}.{key}" if nested else key
        if name in out:
            raise ValueError(f"line {number}: duplicate key {name}")
        if not nested:
            parent = None if value else key
        if value and value != "{}":
            out[name] = value
    return out


class _Tensors(pickle.Unpickler):
    """Unpickler that knows tensors and ordered dicts, and nothing else."""

    def __init__(self, data: bytes, load):
        super().__init__(io.BytesIO(data))
        self._load = load

    def find_class(self, module, name):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return self._tensor
        if module == "torch" and name in STORAGE:
            return STORAGE[name]
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid):
        _, dtype, key, _, count = pid
        return self._load(key, dtype, count)

    @staticmethod
    def _tensor(storage, offset, size, stride, *_):
        need = offset + 1 + sum((n - 1) * s for n, s in zip(size, stride)) if all(size) else offset
        if offset < 0 or need > storage.size or any(s < 0 for s in stride):
            raise ValueError("tensor reaches beyond its storage")
        view = np.lib.stride_tricks.as_strided(
            storage[offset:], size, [s * storage.itemsize for s in stride]
        )
        return np.array(view)


def read_pth(path: str) -> dict[str, np.ndarray]:
    """Named tensors of a ``.pth`` archive (uncompressed zip, little-endian)."""
    with zipfile.ZipFile(path) as z:
        names = {n.split("/", 1)[-1]: n for n in z.namelist()}
        if any(i.compress_type != zipfile.ZIP_STORED for i in z.infolist()):
            raise ValueError("archive entries must be stored uncompressed")
        if "byteorder" not in names or z.read(names["byteorder"]) != b"little":
            raise ValueError("archive must state little byte order")

        def load(key, dtype, count):
            raw = z.read(names[f"data/{key}"])
            if count * np.dtype(dtype).itemsize > min(len(raw), MAX_BYTES):
                raise ValueError("storage is shorter than declared")
            return np.frombuffer(raw, dtype, count)

        return dict(_Tensors(z.read(names["data.pkl"]), load).load())
