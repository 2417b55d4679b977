"""Analytics over document-recognition output, on Spark."""

import os

# The driver's and the workers' small matrices don't gain from BLAS threads, which only fight with Spark's tasks.
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
