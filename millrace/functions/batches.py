"""What a Python operator holds at once."""

#: Rows, and about how many bytes, that are given out together. A batch that comes in may inflate to many times its size.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 12, 8 << 20


def bounded(values, size, rows=ROWS_AT_ONCE, most=BYTES_AT_ONCE):
    """Lists of consecutive values, each of up to ``rows`` or up to the value that brings its bytes to ``most``."""
    held, taken = [], 0
    for value in values:
        held.append(value)
        taken += size(value)
        if len(held) == rows or taken >= most:
            yield held
            held, taken = [], 0
    if held:
        yield held
