"""blockframe.functions"""
