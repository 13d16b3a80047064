"""Training-data operators: host rules, archives, near duplicates, token files, classifiers, shards, decontamination, mixes."""
