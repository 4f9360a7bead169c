"""densitykit: density clustering and waveform analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns lazy DataFrames; nothing is collected on the
driver except small control values (split rows of a kd tree, one changed-row count per
component round).
"""

from densitykit.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
