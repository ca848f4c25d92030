import os

os.environ.setdefault("OMP_NUM_THREADS", "1")  # one thread a task, as the tasks are many
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
