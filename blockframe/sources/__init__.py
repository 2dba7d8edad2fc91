"""blockframe.sources"""
