"""Names, flags and error numbers of the data model."""

from __future__ import annotations

from enum import IntFlag


# Error numbers as the operating system has them (fixed values).
ENOENT, ENXIO, E2BIG, EBUSY, EEXIST, EINVAL, EROFS, ERANGE, EBADFD, EILSEQ, ENOTSUP, ETIMEDOUT, EALREADY = 2, 6, 7, 16, 17, 22, 30, 34, 77, 84, 95, 110, 114


class RecordFlag(IntFlag):
    """Flags of a stored record (fixed values)."""

    REMOVE = 1
    NOCSUM = 2
    APPEND = 16
    EXTHDR = 64
    UNCOMMITTED = 128
    CHUNKED_CSUM = 256


class ScanFlag(IntFlag):
    """What a scan is asked for."""

    DATA = 1
    KEY_RANGE = 2
    TIME_RANGE = 4
    NO_META = 8
    MOVE = 16
    OVERWRITE = 32


class CommandFlag(IntFlag):
    """How a request is sent and answered (fixed values)."""

    NEED_ACK = 1
    MORE = 2
    DESTROY = 4
    DIRECT = 8
    NOLOCK = 16
    CHECKSUM = 32
    NOCACHE = 64
    DIRECT_BACKEND = 128
    REPLY = 512


class WriteFlag(IntFlag):
    """How a write changes what is stored (fixed values)."""

    APPEND = 2
    PREPARE = 16
    COMMIT = 32
    OVERWRITE = 128
    NOCSUM = 256
    PLAIN_WRITE = 512


class Category(IntFlag):
    """Parts of a statistics report (fixed values)."""

    CACHE = 1
    IO = 2
    COMMANDS = 4
    BACKEND = 16
    TOP = 128


class StoreError(ValueError):
    """A request that cannot be carried out; errno names the reason."""

    def __init__(self, errno: int, text: str):
        super().__init__(text)
        self.errno = errno


#: Columns that identify and describe a replica.
INFO = ("group_id", "ts_sec", "size", "user_flags", "record_flags")
#: Bytes of the header that stands before the value of a record with EXTHDR.
HEADER = 48


def uncommitted(column: str = "record_flags"):
    from pyspark.sql import functions as F

    return F.col(column).bitwiseAND(int(RecordFlag.UNCOMMITTED)) != 0
