"""Arrow columns in slices of bounded size, for functions over Python values.

An Arrow batch may hold 64 MB of texts. As Python objects that is several times as
much, so only one slice of a batch at a time is turned into them.
"""

import pyarrow as pa

SIZE = 2 << 20


def portions(*columns, size=SIZE):
    """Lists of Python values of equally long columns, by consecutive rows of about `size` bytes."""
    rows, total = len(columns[0]), sum(c.nbytes for c in columns)
    step = max(1, rows * size // max(1, total))
    for start in range(0, rows, step):
        yield tuple(c.slice(start, step).to_pylist() for c in columns)


def joined(parts, of: pa.DataType) -> pa.Array:
    """One column of the values of all `parts`, each a list or NumPy array; NaN is null."""
    return pa.concat_arrays([pa.array([], of), *(pa.array(p, of, from_pandas=True) for p in parts)])
