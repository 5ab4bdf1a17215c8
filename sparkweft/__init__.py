"""sparkweft: DataFrame operators for keyed synchronisation, document merging,
sequence numbering, text clean-up and report tallying, plus (in ``llm``) the
building blocks of a training-data pipeline."""

__version__ = "0.1.0"
