"""Query graphs: model, rewrites and the compiler to DataFrame joins."""
