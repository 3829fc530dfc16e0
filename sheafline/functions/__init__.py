"""Part of sheafline."""
