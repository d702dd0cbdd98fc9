"""strandframe: sequence, k-mer and assembly-graph analytics as Spark DataFrame operators."""

from strandframe.session import build_session, checkpointed, ensure_checkpoint_dir

__all__ = ["build_session", "checkpointed", "ensure_checkpoint_dir"]
