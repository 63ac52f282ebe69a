"""Small sequential models the set-based operators must equal."""

from quotegrid.params import BOOK_COLUMNS

BOOK_SCHEMA = ("seq bigint, sequence bigint, instrument_id bigint, symbol string, file_date string, recv_ns bigint, event_ns bigint, flags int, "
               + ", ".join(f"{c} double" if "_px_" in c else f"{c} bigint" for c in BOOK_COLUMNS))


def message(seq, recv, flags=128, valid=True, day="2024-01-02"):
    book = []
    for c in BOOK_COLUMNS:
        level = int(c[-2:])
        if c.startswith("bid_px"):
            book.append(100.0 - level * 0.25)
        elif c.startswith("ask_px"):
            book.append((100.25 if valid else 99.0) + level * 0.25)
        else:
            book.append(5 + level)
    return (seq, seq, 1, "EVT", day, recv, recv, flags, *book)


def sample(rows, interval, age):
    """Snapshots (grid time, sequence), skip counts and ranges of one file, message by message."""
    boundary = last = good = None
    opened, why = False, None
    out, skips, ranges = [], {}, []
    for row in rows:
        seq, recv, flags = row[0], row[5], row[7]
        if flags & 8:
            good, opened, why = None, True, "unreliable_receive_state"
            continue
        if boundary is None:
            boundary = recv // interval * interval + interval
        while boundary <= recv:
            if good and not opened and boundary - good[1] <= age:
                out.append((boundary, good[0]))
                ranges.append((boundary, boundary + interval, "emitted", good[1], last))
            else:
                reason = why if opened or good is None else "stale_completed_book"
                skips[reason] = skips.get(reason, 0) + 1
                done = good[1] if good else None
                if ranges and ranges[-1][1] == boundary and ranges[-1][2:] == (reason, done, last):
                    ranges[-1] = (ranges[-1][0], boundary + interval, reason, done, last)
                else:
                    ranges.append((boundary, boundary + interval, reason, done, last))
            boundary += interval
        last = recv
        if not flags & 128:
            opened = True
            if good is not None or why is None:
                why = "incomplete_event"
            continue
        opened = False
        if flags & 4 or row[BOOK_AT["ask_px_00"]] < row[BOOK_AT["bid_px_00"]]:
            good, why = None, "bad_book_flag" if flags & 4 else "invalid_completed_book"
        else:
            good, why = (seq, recv), None
    return out, skips, ranges


BOOK_AT = {c: 8 + i for i, c in enumerate(BOOK_COLUMNS)}
