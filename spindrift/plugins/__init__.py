"""Classes to load by path: a dataset, a sampler and a tool, as a user writes them."""
