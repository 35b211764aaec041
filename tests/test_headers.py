"""Module headers name only the survey's methods that the module holds."""

import pytest

from hedgerow.operators import heads, resample, splits


@pytest.mark.parametrize(("module", "ids"), [(heads, "MDL1-MDL8, MDL11,"), (resample, "BST1-BST5)"), (splits, "SPL1, SPL2, SPL5-SPL10,")])
def test_headers(module, ids):
    assert ids in module.__doc__
