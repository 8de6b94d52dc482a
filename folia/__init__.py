"""folia: AFP / MO:DCA print streams as DataFrames, and corpus operators."""
