"""Statuses and the exception that carries them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Code(str, Enum):
    OK = "kOk"
    INVALID_ARGUMENT = "kInvalidArgument"
    NOT_FOUND = "kNotFound"
    ALREADY_EXISTS = "kAlreadyExists"
    DIMENSION_MISMATCH = "kDimensionMismatch"
    IO_ERROR = "kIoError"
    CORRUPTION = "kCorruption"
    CHECKSUM_MISMATCH = "kChecksumMismatch"
    BAD_RECORD = "kBadRecord"
    BAD_HEADER = "kBadHeader"
    VERSION_MISMATCH = "kVersionMismatch"
    EOF = "kEof"
    UNIMPLEMENTED = "kUnimplemented"
    INTERNAL = "kInternal"


@dataclass(frozen=True)
class Status:
    code: Code = Code.OK
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.code is Code.OK


class EngineError(Exception):
    """A failed operation; ``code`` says how it failed."""

    def __init__(self, code: Code, message: str = "") -> None:
        super().__init__(f"{code.value}: {message}" if message else code.value)
        self.code, self.message = code, message

    @property
    def status(self) -> Status:
        return Status(self.code, self.message)
