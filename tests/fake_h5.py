"""The part of h5py's interface that the readers and writers use, kept in a pickle: h5py isn't installed here."""

import pickle

import numpy as np


class Dataset:
    def __init__(self, data):
        self.data, self.attrs = np.asarray(data), {}

    shape = property(lambda self: self.data.shape)

    def __getitem__(self, at):
        return self.data[at]

    def __len__(self):
        return len(self.data)


class Group:
    def __init__(self):
        self.items, self.attrs, self.read = {}, {}, []

    def __getitem__(self, name):
        self.read.append(name)
        return self.items[name]

    def __contains__(self, name):
        return name in self.items

    def __len__(self):
        return len(self.items)

    def keys(self):
        return self.items.keys()

    def values(self):
        return self.items.values()

    def create_group(self, name):
        return self.items.setdefault(name, Group())

    def create_dataset(self, name, data):
        return self.items.setdefault(name, Dataset(data))


class File(Group):
    def __init__(self, path, mode="r"):
        super().__init__()
        self.path, self.mode = path, mode
        if mode == "r":
            with open(path, "rb") as f:
                self.items, self.attrs = pickle.load(f)

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if self.mode == "w" and kind is None:
            with open(self.path, "wb") as f:
                pickle.dump((self.items, self.attrs), f)
