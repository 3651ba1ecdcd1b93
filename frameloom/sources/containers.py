"""A trajectory file as one npz archive, with the part of h5py's interface that readers and writers here use.

Members are the data sets by their path (``frames/control``), read when they are first sliced; attributes are a JSON member.
It serves where h5py is missing: the layout of groups, data sets and attributes is the same.
"""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np

ATTRIBUTES = "attributes.json"


class Dataset:
    def __init__(self, archive: Archive, name: str):
        self.archive, self.name = archive, name
        self.attrs = archive.attributes.setdefault(name, {})
        self._data = None

    def _header(self):
        with self.archive.zip.open(f"{self.name}.npy") as f:
            version = np.lib.format.read_magic(f)
            return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)

    @property
    def shape(self) -> tuple[int, ...]:
        """By the member's header alone."""
        return self._header()[0]

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, at):
        if self._data is None:
            self.archive.decoded.append(self.name)
            with self.archive.zip.open(f"{self.name}.npy") as f:
                self._data = np.lib.format.read_array(io.BytesIO(f.read()), allow_pickle=False)
        return self._data[at]


class Group:
    def __init__(self, archive: Archive, prefix: str):
        self.archive, self.prefix = archive, prefix
        self.attrs = archive.attributes.setdefault(prefix.rstrip("/"), {})

    def keys(self) -> list[str]:
        """Names of what is directly inside, in the order of writing."""
        names = [n[len(self.prefix) :].split("/")[0] for n in self.archive.names if n.startswith(self.prefix)]
        return list(dict.fromkeys(names))

    def values(self) -> list:
        return [self[k] for k in self.keys()]

    def __contains__(self, name: str) -> bool:
        return name in self.keys()

    def __len__(self) -> int:
        return len(self.keys())

    def __getitem__(self, name: str):
        whole = self.prefix + name
        if whole in self.archive.names:
            return Dataset(self.archive, whole)
        if name not in self:
            raise KeyError(whole)
        return Group(self.archive, whole + "/")

    def create_group(self, name: str) -> Group:
        return Group(self.archive, f"{self.prefix}{name}/")

    def create_dataset(self, name: str, data) -> Dataset:
        whole = self.prefix + name
        with self.archive.zip.open(f"{whole}.npy", "w", force_zip64=True) as f:
            np.lib.format.write_array(f, np.asarray(data), allow_pickle=False)
        self.archive.names.append(whole)
        return Dataset(self.archive, whole)


class Archive(Group):
    """An archive open for reading or writing. path: a path or a file object. decoded: the data sets that were read."""

    def __init__(self, path, mode: str = "r"):
        self.mode = mode
        self.zip = zipfile.ZipFile(path, mode, zipfile.ZIP_DEFLATED, compresslevel=1)
        self.names = [n[:-4] for n in self.zip.namelist() if n.endswith(".npy")]
        self.attributes: dict[str, dict] = json.loads(self.zip.read(ATTRIBUTES)) if ATTRIBUTES in self.zip.namelist() else {}
        self.decoded: list[str] = []
        super().__init__(self, "")

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.mode == "w" and kind is None:
            self.zip.writestr(ATTRIBUTES, json.dumps(self.attributes))
        self.zip.close()
