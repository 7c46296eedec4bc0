"""Operations for large training-data pipelines; see the modules for contracts."""
