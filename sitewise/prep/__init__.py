"""Dataset preparation: folds, strata, manifests and resumable runs."""
