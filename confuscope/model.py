"""Schemas of the long tables that stand for the engine's data model.

A matrix is ``cells`` (sparse, zero cells absent) with ``labels`` (the complete label list, since a
label may have no cell). ``script`` is the group key: one matrix for each script.
"""

CELLS = "script string, true_char string, pred_char string, n double"
LABELS = "script string, idx int, ch string"
PAIRS = "script string, true_char string, pred_char string"
TRUTH = "script string, filename string, text string"
SEGMENTS = "script string, source_file string, segment_index int, text string"
SPECTRAL = (
    "script string, matrix_size int, bistochastic_spectrum array<double>, symmetric_spectrum array<double>, laplacian_spectrum array<double>, "
    "bistochastic_gap double, symmetric_gap double, fiedler_value double, iterations int, converged boolean, row_error double, col_error double"
)
DISTANCES = "a string, b string, d double, method string"

KEYS = ("script", "true_char", "pred_char")
