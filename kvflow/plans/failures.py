"""Why a job failed, and what that means for its users."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from enum import StrEnum

from kvflow.plans.registry import ConfigError


class Category(StrEnum):
    UNKNOWN = "unknown"
    INPUT = "input"
    INTERMEDIATE = "intermediate"
    CONFIG = "config"
    WORKER = "worker"


# Beginnings of failure reasons.
PREFIXES = {"input_read:": Category.INPUT, "config:": Category.CONFIG, "intermediate_": Category.INTERMEDIATE, "shuffle_": Category.INTERMEDIATE, "output_": Category.INTERMEDIATE}
#: Error conditions of Spark, and Java exceptions, that a failed read of the input leaves in a message.
READ_SIGNS = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "LINE_TOO_LONG", "java.io.FileNotFoundException", "java.io.EOFException", "AccessControlException")
FETCH_SIGNS = ("FetchFailed", "MetadataFetchFailed")
#: What each category tells the one who submitted the job.
ADVICE = {
    Category.INPUT: "the input could not be read",
    Category.CONFIG: "the job's configuration is not usable",
    Category.INTERMEDIATE: "data of the job's own could not be written or read",
}


class StageError(RuntimeError):
    """A failure whose reason begins with the prefix of the place where it was raised."""


def classify(reason: str) -> Category:
    reason = reason.strip()
    return next((category for prefix, category in PREFIXES.items() if reason.startswith(prefix)), Category.WORKER)


def is_worker_fault(category: Category) -> bool:
    return category in (Category.WORKER, Category.UNKNOWN)


def is_retried(category: Category) -> bool:
    """Bad input and bad configuration fail a job at once."""
    return category not in (Category.INPUT, Category.CONFIG)


def reason_of(error: BaseException, place: str = "") -> str:
    """A reason with its prefix: by the kind of error, by what Spark says of it, and else by the place where it was raised."""
    text = str(error)
    if isinstance(error, StageError):
        return text
    if isinstance(error, ConfigError):
        return f"config: {text}"
    if any(sign in text for sign in READ_SIGNS):
        return f"input_read: {text}"
    if any(sign in text for sign in FETCH_SIGNS):
        return f"shuffle_fetch: {text}"
    return f"{place}: {text}" if place else text


@contextmanager
def raised_in(place: str) -> Iterator[None]:
    """Names the place in the reason of OS errors and errors of the file system that are raised inside."""
    try:
        yield
    except StageError:
        raise
    except OSError as error:
        raise StageError(reason_of(error, place)) from error


def message(reason: str, base: str, file: str = "") -> str:
    """What users are told: the base, the advice of the category, the file if one is named, and the reason without its prefix."""
    reason = reason.strip()
    if not reason:
        return base
    category = classify(reason)
    detail = reason.partition(":")[2].strip() if category in ADVICE else reason
    return ": ".join(part for part in (base, ADVICE.get(category, ""), file, detail.splitlines()[0] if detail else "") if part)
