"""Errors by code."""

from __future__ import annotations

# The codes.
CODES = ("invalid_argument", "invalid_container", "invalid_metadata", "unsupported_format", "decode_failed", "processing_failed", "encode_failed", "io_failed", "device_lost")


class EngineError(Exception):
    code = "processing_failed"

    def __init__(self, message: str) -> None:
        super().__init__(f"{self.code}: {message}")


def _kind(code: str) -> type[EngineError]:
    name = "".join(x.title() for x in code.split("_"))
    return type(name, (EngineError, ValueError) if code.startswith("invalid_") else (EngineError,), {"code": code})


InvalidArgument, InvalidContainer, InvalidMetadata, UnsupportedFormat, DecodeFailed, ProcessingFailed, EncodeFailed, IoFailed, DeviceLost = map(_kind, CODES)
