"""Tables that the operators exchange.

A matrix of N samples by M variants (or features) is kept by variant: one row holds all samples' values in an
array ordered by sample_idx, a null element being a missing value. Allele frequencies, centring, scaling and
norms are then narrow, and only sums over variants leave a task.
"""

VARIANTS = "variant_idx long, chr string, id string, cm double, bp long, a1 string, a2 string"
SAMPLES = "sample_idx int, fid string, iid string"
GENO = "variant_idx long, g array<double>"
LIKELIHOODS = "variant_idx long, p0 array<double>, p1 array<double>"
COUNTS = "feature string, sample string, n double"
SCORES = "sample_idx int, pc int, u double"
LOADINGS = "variant_idx long, pc int, v double"
SPECTRUM = "pc int, sigval double, eigval double"
