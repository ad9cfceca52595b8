"""A PySpark-native engine for prior-guided topic discovery over text corpora."""

__version__ = "0.2.0"

#: Names that load on first use, so that importing the package starts nothing.
_EXPORTS = {
    "SpectralNet": "operators.network", "ScaSE": "operators.network", "Autoencoder": "operators.network", "ScalableEmbedding": "operators.spectral", "Mixture": "operators.cluster",
    "MatrixPriorLDA": "operators.lda", "Settings": "plans.pipeline", "run_prior": "plans.pipeline", "run_embedding_prior": "plans.pipeline", "run_topic_model": "plans.pipeline", "run_graph": "plans.pipeline",
    "save_model": "sources.models", "load_model": "sources.models", "knn_score": "operators.metrics", "grassmann": "operators.metrics",
}


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_EXPORTS[name]}", __name__), name)
