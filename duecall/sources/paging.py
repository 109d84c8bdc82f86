"""Reading a source page by page: where to stop, and never to cut short in silence. Runs on the driver, at the edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def cursor_pages(fetch: Callable[[str, int], tuple[list, str | None]], size: int = 250, most_pages: int = 20, wanted: int | None = None) -> Iterator[list]:
    """The pages of a source with cursors: fetch(cursor, size) gives rows and the next cursor.

    Ends at a short page, at a missing or repeated cursor, or once ``wanted`` rows and half as
    many again are there, as some are dropped later; a source that goes on after most_pages is an error.
    """
    cursor, seen, n = "*", set(), 0
    for _ in range(most_pages):
        rows, after = fetch(cursor, size)
        yield rows
        n += len(rows)
        seen.add(cursor)
        if len(rows) < size or after is None or after in seen or (wanted is not None and 2 * n >= 3 * wanted):
            return
        cursor = after
    raise OverflowError(f"more than {most_pages} pages of {size}")


def complete(rows: list, cap: int) -> list:
    """rows, unless there are as many as the source's cap: then some may be missing, which is an error."""
    if len(rows) >= cap:
        raise OverflowError(f"{len(rows)} rows reach the cap of {cap}")
    return rows
