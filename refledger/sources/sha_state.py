"""SHA-256 that stops between two blocks and goes on in another process.

Python's hash objects can't be written down. The library below them keeps the eight words of FIPS 180-4 and a count
in a plain struct, and these are all that a second process needs.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import struct
from functools import lru_cache

# Bytes after which nothing but the eight words is left to carry.
STEP = 64


class _Context(ctypes.Structure):
    """SHA256_CTX of OpenSSL's libcrypto."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8), ("nl", ctypes.c_uint32), ("nh", ctypes.c_uint32),
        ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint),
    ]


class Sha256:
    """Goes on after `done` bytes from their `state`; `done` is a multiple of STEP."""

    def __init__(self, library: ctypes.CDLL, state: bytes | None = None, done: int = 0):
        self._library, self._context = library, _Context()
        library.SHA256_Init(ctypes.byref(self._context))
        if state is not None:
            self._context.h[:] = struct.unpack(">8I", state)
            self._context.nh, self._context.nl = divmod(8 * done, 1 << 32)

    def update(self, block: bytes) -> None:
        self._library.SHA256_Update(ctypes.byref(self._context), ctypes.c_char_p(block), ctypes.c_size_t(len(block)))

    def state(self) -> bytes:
        if self._context.num:
            raise ValueError(f"a state can be carried on only after a multiple of {STEP} bytes")
        return struct.pack(">8I", *self._context.h)

    def digest(self) -> bytes:
        out = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, ctypes.byref(self._context))
        return out.raw


def _agrees(library: ctypes.CDLL) -> bool:
    """Does a hash carried on in the middle, and past the first word of the count, end as it should?"""
    body, first = bytes(range(256)) * 5, Sha256(library)
    first.update(body[:640])
    second = Sha256(library, first.state(), 640)
    second.update(body[640:])
    far = Sha256(library, first.state(), 5 << 29)
    counted = (far._context.nh, far._context.nl) == (5, 0)
    return counted and second.digest() == hashlib.sha256(body).digest()


@lru_cache(maxsize=1)
def library() -> ctypes.CDLL | None:
    """The libcrypto that Python itself uses, or the system's; None if neither offers such states."""
    import _hashlib

    for find in (lambda: _hashlib.__file__, lambda: ctypes.util.find_library("crypto")):
        try:
            found = ctypes.CDLL(find())
            if _agrees(found):
                return found
        except (OSError, AttributeError, TypeError):
            continue
    return None
