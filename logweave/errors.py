"""Errors with the status and message that a caller sees."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

from logweave.sources.snapshots import Conflict

#: Parts of exception names and error classes that mean that the storage can't be reached or read now.
STORAGE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "FileNotFoundException", "java.io.IOException", "ConnectException", "SocketTimeoutException", "UnknownHostException", "NoRouteToHostException", "EOFException")


class EngineError(Exception):
    def __init__(self, status: int, message: str, retry_after: int | None = None, body: dict | None = None):
        super().__init__(message)
        self.status, self.message, self.retry_after, self.body = status, message, retry_after, body


def is_unavailable(error: BaseException) -> bool:
    """Is it the storage that failed, so that the same request may succeed later?"""
    if isinstance(error, (OSError, Conflict)):
        return True
    return isinstance(error, (Py4JJavaError, PySparkException)) and any(x in str(error) for x in STORAGE)


@contextmanager
def guarded(context: SparkContext, seconds: float = 0) -> Iterator[None]:
    """Jobs of this block are cancelled after ``seconds`` (0: never); what is not an EngineError leaves as one.

    A storage that can't be reached is 503 with a time to retry after, a deadline and everything else 500.
    """
    tag, late = f"logweave-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel) if seconds else None
    context.addJobTag(tag)
    try:
        if timer:
            timer.daemon = True
            timer.start()
        yield
        if late.is_set():
            raise EngineError(500, "internal server error")
    except EngineError:
        raise
    except Exception as e:
        if not late.is_set() and is_unavailable(e):
            raise EngineError(503, "database is unavailable", retry_after=1) from e
        raise EngineError(500, "internal server error") from e
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
