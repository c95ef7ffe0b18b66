"""Fixed values stay consistent with each other and with the typed layouts."""
from vetline import fixed
from vetline.operators.listing_db import LISTING_TYPES


def test_board_values_consistent():
    assert set(fixed.STATUS_FOR_COLUMN) == set(fixed.BOARD_COLUMNS)
    assert set(fixed.DATE_COLUMN_FOR) <= set(fixed.BOARD_COLUMNS)
    assert set(fixed.ACTIVE_COLUMNS) <= set(fixed.BOARD_COLUMNS)
    assert set(fixed.DATE_COLUMN_FOR.values()) <= set(fixed.LISTING_COLUMNS)


def test_listing_layout():
    assert list(LISTING_TYPES) == fixed.LISTING_COLUMNS
    assert len(fixed.LISTING_COLUMNS) == 20 and fixed.LEGACY_COLUMN_COUNT == 13


def test_language_sets():
    b1_plus = set(fixed.LEVELS_B2_PLUS) | set(fixed.LEVELS_B1_EXTRA)
    assert set(fixed.LEVELS_B2_PLUS) < b1_plus
    assert not (set(fixed.LANG_FRENCH) | set(fixed.LANG_DUTCH)) & set(fixed.LANG_EXEMPT)
    assert all(k == k.strip().lower() for k in fixed.DEFAULT_EXCLUSION_KEYWORDS)
