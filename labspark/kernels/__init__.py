"""Dense numeric kernels in numpy; operators ship them to executors in Arrow batches."""
