"""Features, classifiers, tuning, ensembles and scoring."""
