"""Training-data operators: sharding, search, decontamination, scoring, formatting, tokens, secrets and near copies."""
