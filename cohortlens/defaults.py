"""Default parameters of the analysis.

Fixed values: these defaults reproduce the analysed program's choices.
"""

K_BASELINE = 5            # k of the fixed-k k-means
K_MIN, K_MAX = 2, 10      # inclusive k range of the silhouette sweep
SEED = 42                 # k-means seed
KMEANS_MAX_ITER = 50      # iteration cap of the fixed-k and sweep fits
COARSE_MAX_ITER = 30      # iteration cap of the coarse fit of the density method
COARSE_K_PER_PEAK = 5     # coarse k = min(COARSE_K_MAX, max(5 * k_final, COARSE_K_MIN))
COARSE_K_MIN = 20
COARSE_K_MAX = 50
