"""blockframe: a Spark-native engine for distributed arrays, estimators and row pipelines.

The array functions are available here by name; they are imported when first used, so that Python workers stay light.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_WHERE = {
    "blockframe.dsarray": "DsArray apply_along_axis apply_elementwise array concat_columns concat_rows eye from_entries from_rows full identity load_blocks_rechunk matadd matsubtract pad random_array zeros",
    "blockframe.functions.elementwise": "exp gammaln log",
    "blockframe.linalg": "kron lanczos_svd matmul qr random_svd svd tsqr",
    "blockframe.sources.readers": "load_hstack_npy_files load_mdcrd_file load_npy_file load_npy_files load_svmlight_file load_txt_file",
    "blockframe.sources.writers": "save_npy_file save_txt",
}
_NAMES = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_NAMES)  # noqa: PLE0605


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(importlib.import_module(_NAMES[name]), name)
    raise AttributeError(f"module 'blockframe' has no attribute {name!r}")
