"""DataFrame operators: quality control, intervals, annotation, linkage disequilibrium, trees."""
