"""evgraph.functions"""
