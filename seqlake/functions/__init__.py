"""Part of seqlake."""
