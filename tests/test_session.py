import os

import pytest

from conftest import rows
from pairloom.session import materialize, scratch


def there(df):
    return os.path.isdir(df.stored_at.removeprefix("file:"))


def test_a_block_drops_what_it_does_not_keep(spark):
    before = materialize(spark.range(3), "before")
    with scratch(spark) as keep:
        gone = materialize(spark.range(4), "gone")
        with scratch(spark) as keep_inner:
            inner = keep_inner(materialize(spark.range(5), "inner"))
            lost = materialize(spark.range(6), "lost")
        assert there(inner) and not there(lost) and there(gone)
        kept = keep(materialize(inner.join(gone, "id"), "kept"))
    assert there(before) and there(kept) and not there(gone) and not there(inner)
    assert rows(kept) == [(0,), (1,), (2,), (3,)]


def test_a_block_that_fails_is_cleaned_too(spark):
    with pytest.raises(RuntimeError):
        with scratch(spark):
            made = materialize(spark.range(2), "made")
            raise RuntimeError
    assert not there(made)
