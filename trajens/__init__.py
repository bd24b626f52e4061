"""trajens — combine, weight and score simulated trajectory ensembles on Spark.

Every public function takes DataFrames (long trajectory / quantile tables) and
returns a lazily planned DataFrame; nothing is collected to the driver.
"""

from trajens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
